"""Operator 4: secret scans by a linear-chain conditional random field over tokens.

Three patterns give base spans. A conditional random field then tags every token of every whole text as
the beginning of a secret, inside one, or outside, from the token's shape, its neighbours' shapes and
key words, the characters around it and features of the whole file; the Viterbi path gives spans, of
which those that touch no base span are added.

The field is trained here, on windows of a bounded sample of documents: up to ``SAMPLE`` that may hold a
base span and as many others, those of the smallest hash. What it learns from are their base spans and
secrets of other FORMS, made up and put into copies of the windows (other key words, ``Bearer`` headers,
prefixed keys, dotted tokens, passwords in addresses), beside made-up strings that are none (dates, versions, numbers,
names, key words in plain sentences). So it finds secrets that the patterns don't know, and those of forms that it
was not shown as well.

Features and scores are numpy arrays over all tokens of a batch. The Viterbi path is exact, but is only
worked out where it can leave "outside": over a run of tokens, no path through a token can gain on
staying outside when the best sums of upper bounds to its left and right, with its own, stay at 0 or less.

Edge cases: a null text counts as empty and has no spans; without any text to learn from, the field adds
none; of several texts with one id, the least is learnt from; repeated rows each give a row; other columns
are not read; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boutflow.llm.common import cut_lineage, per_batch

SAMPLE = 400
#: Tokens of a training window, on both sides of a span or of a place chosen by the document's length.
REACH = 20
#: Windows around base spans that a document gives to the training at most, spread over all of its spans.
WINDOWS = 8
STEPS = 60
#: Characters whose features are held at a time (or one document's, if longer).
PIECE = 2_000_000
KINDS = ("assign", "access", "hex", "crf")

# The base patterns.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
_MAY_ASSIGN = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Words that make a neighbour worth telling.
KEY_WORDS = ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "key", "auth", "bearer", "credential", "credentials", "private", "access_key", "authorization", "private_key", "client_secret", "passphrase", "login")

#: Stems of key words, as parts of names.
_STEM = re.compile("pass|pwd|secret|token|key|auth|cred", re.IGNORECASE)


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the value), in order; positions are code points."""
    out = []
    low = text.lower()
    if any(w in low for w in _MAY_ASSIGN):
        out += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(out)


# Features --------------------------------------------------------------------------------------------

_LOWER, _HEX, _UPPER, _DIGIT, _SIGN, _WIDE = 1, 2, 3, 4, 5, 6
_CLASS = np.zeros(129, np.uint8)
for _c in range(128):
    _ch = chr(_c)
    _CLASS[_c] = _HEX if _ch in "abcdef" else _LOWER if _ch.islower() else _UPPER if _ch.isupper() else _DIGIT if _ch.isdigit() else _SIGN if _ch in "+/_.-" else 0
_CLASS[128] = _WIDE
_AROUND = np.full(129, 7, np.uint8)
for _k, _s in enumerate((" ", "\"'`", "=", ":", "@", "\n\r", "<>()[]{},;")):
    for _ch in _s:
        _AROUND[ord(_ch)] = _k
_LENGTHS = np.array([4, 6, 8, 12, 16, 24, 40])
#: Values of each feature: length, shape, hexadecimal by length, digits by changes of class, key word one
#: or two tokens before, character before, character after, an assignment within three characters before,
#: shape before, shape after, file, constant; and, together, the characters before and after, the number of kinds of
#: characters and the length, dots and the mean length between them, hexadecimal parts between dashes by a key word,
#: changes of class by length, a part of a word before that is a key word, by an assignment, and signs of a key before by digits
#: and length.
SIZES = (8, 32, 16, 20, 4, 8, 8, 2, 32, 32, 16, 1, 64, 40, 12, 8, 64, 4, 48)
OFFSETS = np.concatenate([[0], np.cumsum(SIZES)[:-1]])
N_FEATURES = sum(SIZES)


class Tokens:
    """Tokens of texts: runs of letters, digits and ``+/_.-``, with their places and features."""

    def __init__(self, texts: list[str]):
        self.sizes = np.array([len(t) for t in texts], np.int64)
        joined = "\n".join(texts) + "\n\n\n\n"
        codes = np.minimum(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4"), 128)
        kind = _CLASS[codes]
        inside = kind > 0
        edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))
        self.start, self.end = edge[::2], edge[1::2]
        self.offset = np.concatenate([[0], np.cumsum(self.sizes + 1)[:-1]]) if len(texts) else np.zeros(0, np.int64)
        self.doc = np.searchsorted(self.offset, self.start, "right") - 1
        n = len(self.start)
        self.features = np.zeros((n, len(SIZES)), np.int32)
        if not n:
            return
        length = self.end - self.start

        def count(mask: np.ndarray) -> np.ndarray:
            sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int32)])
            return sums[self.end] - sums[self.start]

        digit, hexed, upper, sign, wide = (count(kind == k) for k in (_DIGIT, _HEX, _UPPER, _SIGN, _WIDE))
        lower = length - digit - upper - sign - wide
        dots, dashes = count(codes == 46), count(codes == 45)
        changes = count(np.diff(np.where(kind == _HEX, _LOWER, kind), prepend=kind[:1]) != 0)
        shape = (lower > 0) + 2 * (upper > 0) + 4 * (digit > 0) + 8 * (sign > 0) + 16 * (wide > 0)
        size = np.searchsorted(_LENGTHS, length, "right")
        before, after = codes[np.maximum(self.start - 1, 0)], codes[self.end]
        before = np.where(self.start == 0, 10, before)
        assign = np.zeros(n, bool)
        for back in (1, 2, 3):
            at = self.start - back
            c = codes[np.maximum(at, 0)]
            assign |= (at >= 0) & ((c == 61) | (c == 58))
        same = np.concatenate([[False], self.doc[1:] == self.doc[:-1]])
        key = self._key_words(joined, codes, length)
        key1 = np.concatenate([[False], key[:-1]]) & same
        key2 = np.concatenate([[False, False], key[:-2]])[:n] & same & np.concatenate([[False], same[:-1]])
        shape_before = np.where(same, np.concatenate([[0], shape[:-1]]), 0)
        shape_after = np.where(np.concatenate([same[1:], [False]]), np.concatenate([shape[1:], [0]]), 0)
        tokens = np.bincount(self.doc, minlength=len(texts))
        keys = np.bincount(self.doc, key1 & assign, len(texts)) > 0
        digits = np.bincount(self.doc, digit > 0, len(texts)) * 50 > tokens
        file = np.searchsorted([50, 500, 5000], tokens) + 4 * keys + 8 * digits
        kinds = (lower > 0).astype(np.int64) + (upper > 0) + (digit > 0) + (sign > 0)
        parts = 4 * np.minimum(dots, 2) + np.searchsorted([4, 8, 16], length // (dots + 1), "right")
        dashed = (dashes >= 2) & (hexed + digit + dashes == length)
        near = key1 | key2
        stem = np.concatenate([[False], self._stems(joined)[:-1]]) & same
        columns = (size, shape, 8 * (hexed + digit == length) + size, 4 * np.minimum(4 * digit // length, 4) + np.minimum(4 * changes // (length + 1), 3), key1 + 2 * key2, _AROUND[before], _AROUND[after], assign, shape_before, shape_after, file[self.doc], 0,
            8 * _AROUND[before] + _AROUND[after], 8 * kinds + size, parts, 4 * dashed + 2 * (dashed & (digit > 0)) + near, 8 * size + np.minimum(10 * changes // (length + 1), 7), 2 * stem + assign, 16 * np.minimum(near.astype(np.int64) + assign + stem, 2) + 8 * (digit > 0) + size)
        for k, c in enumerate(columns):
            self.features[:, k] = c + OFFSETS[k]

    def _stems(self, joined: str) -> np.ndarray:
        """Tokens of up to 40 characters that have a stem of a key word in them."""
        out = np.zeros(len(self.start), bool)
        places = np.array([m.span() for m in _STEM.finditer(joined)], np.int64).reshape(-1, 2)
        at = np.searchsorted(self.start, places[:, 0], "right") - 1
        good = (at >= 0) & (places[:, 1] <= self.end[at]) & (self.end[at] - self.start[at] <= 40)
        out[at[good]] = True
        return out

    def _key_words(self, joined: str, codes: np.ndarray, length: np.ndarray) -> np.ndarray:
        key = np.zeros(len(length), bool)
        fold = lambda c: np.where((c >= 65) & (c <= 90), c + 32, c)
        first, last, middle = fold(codes[self.start]), fold(codes[self.end - 1]), fold(codes[self.start + length // 2])
        for w in KEY_WORDS:
            for i in np.flatnonzero((length == len(w)) & (first == ord(w[0])) & (last == ord(w[-1])) & (middle == ord(w[len(w) // 2]))):
                key[i] = joined[self.start[i] : self.end[i]].lower() == w
        return key


# The field -------------------------------------------------------------------------------------------

_NEVER = -30.0


class Field:
    """States: 0 outside, 1 beginning, 2 inside. A text stands between two outside tokens."""

    def __init__(self, weights: np.ndarray | None = None, moves: np.ndarray | None = None):
        self.weights = np.zeros((N_FEATURES, 3)) if weights is None else weights
        self.moves = np.zeros((3, 3)) if moves is None else moves
        self.moves[0, 2] = _NEVER

    def spans(self, tokens: Tokens) -> list[tuple[int, int, int]]:
        """(document, start, end) of each secret on the Viterbi path, in order."""
        n = len(tokens.start)
        if not n or not self.weights.any():
            return []
        gain = np.zeros((n, 2))
        table = self.weights[:, 1:] - self.weights[:, :1]
        for k in range(len(SIZES)):
            gain += table[tokens.features[:, k]]
        moves = self.moves - self.moves[0, 0]
        leave = max(0.0, moves[1, 0], moves[2, 0])
        most = np.maximum(gain[:, 0] + moves[:, 1].max(), gain[:, 1] + moves[1:, 2].max()) + leave
        new_doc = np.concatenate([[True], tokens.doc[1:] != tokens.doc[:-1]])
        step = most - 1e5 * new_doc  # sums don't reach over documents
        sums = np.cumsum(step)
        left = most + np.maximum(0, np.where(new_doc, 0, (sums - step) - np.minimum.accumulate(np.concatenate([[0.0], (sums - step)[:-1]]))))
        ahead = np.maximum.accumulate(sums[::-1])[::-1] - sums
        live = np.flatnonzero(left + ahead > 0)
        out: list[tuple[int, int, int]] = []
        if len(live):
            cut = np.flatnonzero((np.diff(live) > 1) | (np.diff(tokens.doc[live]) > 0)) + 1
            for run in np.split(live, cut):
                out += [(int(tokens.doc[run[0]]), int(tokens.start[a]), int(tokens.end[b])) for a, b in self._decode(gain, moves, int(run[0]), int(run[-1]))]
        return [(d, s - int(tokens.offset[d]), e - int(tokens.offset[d])) for d, s, e in out]

    @staticmethod
    def _decode(gain: np.ndarray, moves: np.ndarray, first: int, last: int) -> list[tuple[int, int]]:
        """The secrets on the best path over the tokens first to last, outside before and after."""
        best, back = [0.0, -1e9, -1e9], []
        for t in range(first, last + 1):
            own = (0.0, gain[t, 0], gain[t, 1])
            came = [max(range(3), key=lambda s, to=to: best[s] + moves[s, to]) for to in range(3)]
            back.append(came)
            best = [best[came[to]] + moves[came[to], to] + own[to] for to in range(3)]
        state = max(range(3), key=lambda s: best[s] + moves[s, 0])
        tags = []
        for came in reversed(back):
            tags.append(state)
            state = came[state]
        out = []
        for t, tag in enumerate(reversed(tags), first):
            if tag == 1:
                out.append((t, t))
            elif tag == 2:
                out[-1] = (out[-1][0], t)
        return out

    @classmethod
    def train(cls, features: np.ndarray, tags: np.ndarray, held: np.ndarray) -> Field:
        """Fits to windows: features (window, place, feature), tags and whether there is a token (window, place)."""
        field = cls()
        if not (tags > 0).any():
            return field
        n, width = tags.shape
        weights, moves = field.weights, field.moves
        truth = np.eye(3)[tags] * held[:, :, None]
        padded = np.concatenate([np.zeros((n, 1), int), np.where(held, tags, 0), np.zeros((n, 1), int)], 1)
        pairs = np.zeros((3, 3))
        np.add.at(pairs, (padded[:, :-1], padded[:, 1:]), 1)
        state = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(moves), np.zeros_like(moves)]
        for step in range(1, STEPS + 1):
            score = np.zeros((n, width, 3))
            for k in range(len(SIZES)):
                score += weights[features[:, :, k]]
            score[~held] = (0.0, 10 * _NEVER, 10 * _NEVER)  # no token: outside
            go = np.exp(moves)
            level = np.exp(score - score.max(2, keepdims=True))
            ahead = np.zeros((n, width, 3))
            now = np.tile([1.0, 0.0, 0.0], (n, 1))
            for t in range(width):
                now = (now @ go) * level[:, t]
                now /= now.sum(1, keepdims=True)
                ahead[:, t] = now
            behind = np.zeros((n, width, 3))
            later = np.tile(go[:, 0], (n, 1))
            expected = np.zeros((3, 3))
            for t in range(width - 1, -1, -1):
                later /= later.sum(1, keepdims=True)
                behind[:, t] = later
                come = level[:, t] * later
                prior = ahead[:, t - 1] if t else np.tile([1.0, 0.0, 0.0], (n, 1))
                joint = prior[:, :, None] * go * come[:, None, :]
                expected += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
                later = come @ go.T
            final = ahead[:, -1, :, None] * go[:, :1]
            expected[:, :1] += (final / final.sum(1, keepdims=True)).sum(0)
            chance = ahead * behind
            chance /= chance.sum(2, keepdims=True)
            error = (chance * held[:, :, None] - truth) / n
            slope = np.zeros_like(weights)
            for k in range(len(SIZES)):
                for s in range(3):
                    slope[:, s] += np.bincount(features[:, :, k].ravel(), error[:, :, s].ravel(), N_FEATURES)
            for p, g, m, v in ((weights, slope + 1e-4 * weights, *state[:2]), (moves, (expected - pairs) / n + 1e-4 * moves, *state[2:])):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
            moves[0, 2] = _NEVER
        return field


_LETTERS, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
_ANY_CASE = _LETTERS + _LETTERS.upper() + _DIGITS


def _pick(rng: np.random.Generator, alphabet: str, low: int, high: int) -> str:
    return "".join(rng.choice(list(alphabet), rng.integers(low, high)))


#: Forms of made-up secrets.
FORMS = {
    "any case": lambda r: _pick(r, _ANY_CASE, 8, 44), "lower": lambda r: _pick(r, _LETTERS + _DIGITS, 10, 32), "upper hex": lambda r: _pick(r, "0123456789ABCDEF", 24, 44), "base64": lambda r: _pick(r, _ANY_CASE + "+/", 20, 60) + "=",
    "prefixed": lambda r: _pick(r, _LETTERS, 2, 4) + "_" + _pick(r, _LETTERS, 4, 5) + "_" + _pick(r, _ANY_CASE, 20, 40), "short prefix": lambda r: _pick(r, _LETTERS, 3, 4) + "_" + _pick(r, _ANY_CASE, 30, 40),
    "dotted": lambda r: ".".join(_pick(r, _ANY_CASE + "_-", 20, 60) for _ in range(3)), "uuid": lambda r: "-".join(_pick(r, "0123456789abcdef", n, n + 1) for n in (8, 4, 4, 4, 12)), "address": lambda r: _pick(r, _ANY_CASE, 8, 24), "grouped": lambda r: "-".join(_pick(r, _LETTERS.upper() + _DIGITS, 4, 6) for _ in range(5)),
}


def made_up(rng: np.random.Generator, forms: tuple[str, ...] = tuple(FORMS)) -> tuple[str, int, int]:
    """A secret of one of ``forms``, which the base patterns don't know, in its setting; start and end of its value."""
    form = forms[rng.integers(len(forms))]
    value = FORMS[form](rng)
    key = ["pwd", "auth", "private_key", "credential", "credentials", "access_key", "client_secret", "passphrase", "login", "key"][rng.integers(10)]
    key = [key, key.upper(), key.capitalize(), f"{_pick(rng, _LETTERS, 2, 6)}_{key}".upper()][rng.integers(4)]
    settings = [f"{key}={{}}", f"{key}: {{}}", f'{key} = "{{}}"', f"{key} => '{{}}'", f"{key} {{}}", "Authorization: Bearer {}", "bearer {}"]
    if form == "address":  # between a user and a host
        settings = [f"{s}://{_pick(rng, _LETTERS, 3, 9)}:{{}}@{_pick(rng, _LETTERS, 3, 9)}{e}" for s in ("postgres", "mysql", "https", "amqp") for e in (".org/db", ":5432/main")]
    elif form in ("any case", "dotted", "prefixed", "short prefix", "base64") and rng.random() < 0.5:  # such as stand alone too
        settings = ["{}", "with {} then", "({})"]
    elif form == "uuid":
        settings = settings[:5]
    before = settings[rng.integers(len(settings))]
    start = before.index("{")
    return before.format(value), start, start + len(value)


def _harmless(rng: np.random.Generator) -> str:
    """A string that is no secret, though it has digits, capitals or a key word."""
    n = [int(x) for x in rng.integers(1, 10**6, 4)]
    return [
        f"20{n[0] % 25:02}-{n[1] % 12 + 1:02}-{n[2] % 28 + 1:02}", f"v{n[0] % 20}.{n[1] % 30}.{n[2] % 90}", f"{n[0]}{n[1]}", f"+{n[0] % 99} {n[1]} {n[2]}", f"no. {n[0]}", f"{n[0] % 999}.{n[1] % 999}.{n[2] % 99}",
        f"{n[0]:06x}-{n[1]:06x}", "-".join(f"{x % 65536:04x}" for x in (*n, *n)), f"https://site{n[0] % 99}.org:80{n[1] % 99:02}/a", f"{n[0] % 9}:{n[1] % 9}@home", "e.g.the.next.part", f"lib.so.{n[0] % 9}.{n[1] % 9}", "some_long_name_of_a_thing", "CamelCaseNameOfAThing", f"FileName{n[0]}.tar.gz", f"AB-{n[0] % 9999:04}-XY",
        "key: value", "the key to", "auth: none", "login: yes", "password reset", "a bearer of", "private key", f"user{n[0] % 999}", f"page={n[0] % 99}", "ISO/IEC", "HTTP/2", "ABC-DEF", "well-known", f"{n[0] % 23}:{n[1] % 59:02}", f"id={n[0]}", f"www.site{n[0] % 99}.org/page", f"name{n[0] % 99}@mail.org",
    ][rng.integers(33)]


def implanted(text: str, rng: np.random.Generator, forms: tuple[str, ...] = tuple(FORMS)) -> tuple[str, list[tuple[int, int]]]:
    """A stretch of ``text`` with a made-up secret and four harmless strings put between words; the values' places."""
    words = text.split(" ")
    at = int(rng.integers(0, len(words)))
    words = words[max(0, at - 4 * REACH) : at + 4 * REACH]
    secret, start, end = made_up(rng, forms)
    parts = [(int(rng.integers(0, len(words) + 1)), x) for x in (secret, *(_harmless(rng) for _ in range(4)))]
    for place, x in sorted(parts, key=lambda p: -p[0]):
        words.insert(place, x)
    out = " ".join(words)
    from_ = out.index(secret) + start
    return out, [(from_, from_ + end - start)]


def _windows(text: str, forms: tuple[str, ...] = tuple(FORMS)) -> tuple[list[list[int]], list[int]]:
    """Training windows of a text: flat features of each, and tags (-1: no token), REACH * 2 + 1 places."""
    features, out = [], []

    def add(text: str, values: list[tuple[int, int]], background: bool) -> None:
        tokens = Tokens([text])
        n = len(tokens.start)
        tags, middles = np.zeros(n, np.int64), []
        for start, end in values:
            inside = np.flatnonzero((tokens.start < end) & (tokens.end > start))
            if len(inside):
                tags[inside], tags[inside[0]] = 2, 1
                middles.append(int(inside[0]))
        middles = middles[:: max(1, -(-len(middles) // WINDOWS))]
        middles += [n // 4, n // 2, 3 * n // 4] if n and background else []
        for m in dict.fromkeys(middles):
            at = np.arange(m - REACH, m + REACH + 1)
            there = (at >= 0) & (at < n)
            at = np.clip(at, 0, n - 1)
            features.append(np.where(there[:, None], tokens.features[at], 0).ravel().tolist())
            out.append(np.where(there, tags[at], -1).tolist())

    base = [(value, end) for _, _, end, value in base_spans(text)]
    add(text, base, True)
    rng = np.random.default_rng(zlib.crc32(text.encode("utf-8", "surrogatepass")))
    for _ in range(4 if text else 0):
        copy, values = implanted(text, rng, forms)
        add(copy, values + [(value, end) for _, _, end, value in base_spans(copy)], False)
    return features, out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, forms: tuple[str, ...] = tuple(FORMS)) -> Field:
    """Trains the field on windows of at most twice ``sample`` documents, such as may hold a base span and others, with made-up secrets of ``forms``."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null")
    first = lambda some: some.select("id").orderBy(F.xxhash64("id"), "id").limit(sample)
    ids = first(rows.where(F.col("text").rlike(r"(?i:password|passwd|secret|token|api_?key)|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"))).union(first(rows)).distinct()
    chosen = cut_lineage(rows.join(F.broadcast(ids), "id").groupBy("id").agg(F.min("text").alias("text")).repartition(8, "id"))  # twice ``sample`` ids at most

    def make():
        def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            found = [_windows(t or "", forms) for t in batch.column("text").to_pylist()]
            small = pa.list_(pa.list_(pa.int16()))
            return {"features": pa.array([f for f, _ in found], small), "tags": pa.array([t for _, t in found], small)}

        return work

    lists = T.ArrayType(T.ArrayType(T.ShortType()))
    got = per_batch(chosen, make, ["id"], [("features", lists), ("tags", lists)]).toArrow().sort_by("id")
    width = 2 * REACH + 1
    flat = lambda c: pc.list_flatten(pc.list_flatten(got[c])).to_numpy()
    tags = flat("tags").reshape(-1, width).astype(np.int64)
    features = flat("features").reshape(-1, width, len(SIZES))
    return Field.train(features, np.maximum(tags, 0), tags >= 0)


def scan(texts: list[str], field: Field) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """For each text: its base spans and all spans, as (start, kind, end) in order."""
    out = []
    pieces, size = [[]], 0
    for t in texts:
        if size and size + len(t) > PIECE:
            pieces.append([])
            size = 0
        pieces[-1].append(t)
        size += len(t)
    for piece in pieces:
        base = [[(s, k, e) for s, k, e, _ in base_spans(t)] for t in piece]
        every = [list(b) for b in base]
        for d, s, e in field.spans(Tokens(piece)):
            if not any(bs < e and s < be for bs, _, be in base[d]):
                every[d].append((s, 3, e))
        out += [(b, sorted(x)) for b, x in zip(base, every, strict=True)]
    return out


def spans_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_secrets(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: the id, counts by base kind, ``base_sha256`` and ``spans`` (kind:start:end)."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def make():
        field = shared.value

        def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
            found = scan([t or "" for t in batch.column(text_col).to_pylist()], field)
            counts = [[sum(k == kind for _, k, _ in b) for b, _ in found] for kind in range(3)]
            return {f"n_{KINDS[k]}": pa.array(counts[k], pa.int64()) for k in range(3)} | {
                "base_sha256": pa.array([hashlib.sha256(spans_text(b).encode()).hexdigest() for b, _ in found], pa.string()),
                "spans": pa.array([spans_text(x) for _, x in found], pa.string()),
            }

        return work

    added = [*((f"n_{k}", T.LongType()) for k in KINDS[:3]), ("base_sha256", T.StringType()), ("spans", T.StringType())]
    return per_batch(docs.select(id_col, text_col), make, [id_col], added)
