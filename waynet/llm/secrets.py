"""Secrets: base patterns, and a linear-chain conditional random field over tokens.

Tokens are runs without white space, tagged begin, inside or outside of a secret. A tag's
score sums weights of the token's shape, its neighbours' shapes and words, and features of
the whole text. The field is trained by maximum likelihood on windows of a bounded sample:
base matches are labels, and disguised() copies of their surroundings, with a keyword, joint, alphabet and length such
as no base pattern knows, teach it what else secrets look like. Viterbi decoding leaves out no text: a token whose scores
put it outside whatever its neighbours are splits the chain exactly, so only the runs
between such tokens have to be walked.

Offsets count code points, ends exclusive. A null text counts as empty and has no spans;
repeated rows get the same spans. Base spans that overlap all stay; an added span touches none. An empty table gives an
empty result. Columns besides the id and the text are not read. A long text is decoded as a whole, in numpy arrays of its size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waynet.llm.common import bounded_sample, released, slices, whole_text

#: Bounds of the fit: texts with and without a base match, windows, and the tokens of a window.
TEXTS_PER_CLASS, MOST_WINDOWS, WINDOW = 500, 5000, 24
#: Disguised copies of a base match, at most in all, and the code points on each side that they keep.
COPIES, MOST_COPIES, AROUND = 100, 2000, 160
STEPS = 160

#: Fixed values of the contract: kind, pattern, group and least length.
BASE = (
    ("assign", re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 32),
)
#: What disguised copies put for the keyword and for the sign after it.
OTHER_WORDS, JOINTS = ("pwd", "pass phrase", "credential", "credentials", "auth", "login", "private key", "pin"), (" = ", ": ", " is ", " -> ", " ")
KINDS = {"assign": 0, "access": 1, "hex": 2, "crf": 3}
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

O, B, I = 0, 1, 2  # noqa: E741
SPACE, LOWER, UPPER, DIGIT, MARK, OTHER = range(6)


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base matches, by start and then kind as listed."""
    found = []
    for kind, pattern, group, least in BASE:
        found += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(found, key=lambda s: (s[0], KINDS[s[1]]))


def _classes() -> np.ndarray:
    table = np.full(256, OTHER, np.uint8)
    for chars, kind in ((b"abcdefghijklmnopqrstuvwxyz", LOWER), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", UPPER), (b"0123456789", DIGIT), (b"\t\n\v\f\r ", SPACE), (bytes(c for c in range(33, 127) if not chr(c).isalnum()), MARK)):
        table[list(chars)] = kind
    return table


_CLASS = _classes()
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True


def _positions(data: bytes, word: bytes, offsets: np.ndarray) -> np.ndarray:
    """Where the word begins, within one text."""
    out, at = [], data.find(word)
    while at >= 0:
        out.append(at)
        at = data.find(word, at + 1)
    out = np.array(out, np.int64)
    return out[np.searchsorted(offsets, out, side="right") == np.searchsorted(offsets, out + len(word) - 1, side="right")]


class Tokens:
    """Tokens of a slice of texts: byte starts and ends, their text, and feature codes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        kinds = _CLASS[data]
        solid = kinds != SPACE
        inner = np.ones(len(data) + 1, bool)
        inner[offsets] = False
        before = np.concatenate(([False], solid[:-1])) & inner[:-1] if len(data) else np.zeros(0, bool)
        after = np.concatenate((solid[1:], [False])) & inner[1:] if len(data) else np.zeros(0, bool)
        self.starts, self.ends = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
        self.text = np.searchsorted(offsets, self.starts, side="right") - 1
        lowered = data.tobytes().lower()
        self.keyword_at = np.sort(np.concatenate([_positions(lowered, w, offsets) for w in KEYWORDS]))
        access = _positions(data.tobytes(), b"AKIA", offsets)
        self._flag(data, kinds, access, inner)
        count = len(offsets) - 1
        digits = np.concatenate(([False], _HEX[data], [False]))
        first, last = digits[1:-1] & ~(digits[:-2] & inner[:-1]), digits[1:-1] & ~(digits[2:] & inner[1:])
        runs = np.flatnonzero(first)
        long_hex = runs[np.flatnonzero(last) + 1 - runs >= 32]
        self.maybe_base = np.zeros(count, bool)
        for at in (self.keyword_at, access, long_hex):
            self.maybe_base[np.searchsorted(offsets, at, side="right") - 1] = True
        self._codes(count)

    def _flag(self, data, kinds, access, inner):
        n = len(self.starts)
        owner = lambda at: np.unique(np.searchsorted(self.starts, at, side="right") - 1)
        if n:
            sums = [np.add.reduceat(kinds == k, self.starts, dtype=np.int32) for k in (LOWER, UPPER, DIGIT, MARK)]
            turns = np.add.reduceat(np.concatenate(((kinds[1:] != kinds[:-1]) & inner[1:-1], [False])), self.starts, dtype=np.int32)
        else:
            sums, turns = [np.zeros(0, np.int32)] * 4, np.zeros(0, np.int32)
        lower, upper, digit, mark = sums
        size = self.ends - self.starts
        length = np.searchsorted([2, 5, 8, 12, 16, 24, 32], size, side="right")
        mixed = np.minimum(3, turns // 4)
        self.shape = (((length * 2 + (lower > 0)) * 2 + (upper > 0)) * 2 + (digit > 0)) * 2 + (mark > 0)
        self.shape = self.shape * 4 + mixed
        self.length, self.kinds = length, self.shape % 64
        keyed, key_id = np.zeros(n, bool), np.zeros(n, bool)
        if n and len(self.keyword_at):
            keyed[owner(self.keyword_at)] = True
        if n and len(access):
            key_id[owner(access)] = True
        sign = (size == 1) & (np.isin(data[self.starts], list(b"=:"))) if n else np.zeros(0, bool)
        holds = np.zeros(n, bool)
        if n:
            at = np.flatnonzero((data == ord("=")) | (data == ord(":")))
            at = at[at >= self.starts[0]]
            holds[owner(at)] = True
        self.word = ((keyed * 2 + key_id) * 2 + sign) * 2 + holds
        self.digits = np.minimum(3, (4 * digit) // np.maximum(1, size)) * 2 + (upper + digit + mark == size)

    def _codes(self, count):
        n = len(self.starts)

        def shifted(code, by, size):
            out = np.full(n, size, np.int64)
            if by > 0:
                out[by:] = np.where(self.text[by:] == self.text[:-by], code[:-by], size)
            else:
                out[:by] = np.where(self.text[:by] == self.text[-by:], code[-by:], size)
            return out

        per_text = np.bincount(self.text, minlength=count)
        with_key = np.bincount(self.text, self.word >= 8, count) > 0
        file = with_key * 4 + np.minimum(3, (20 * np.bincount(self.text, self.digits >= 2, count)) // np.maximum(1, per_text))
        self.codes = [self.shape, shifted(self.shape, 1, SHAPES), shifted(self.shape, -1, SHAPES), self.word, shifted(self.word, 1, 16), shifted(self.word, 2, 16), shifted(self.word, -1, 16), self.digits, file[self.text].astype(np.int64), self.length, self.kinds]


SHAPES = 8 * 16 * 4
SIZES = [SHAPES, SHAPES + 1, SHAPES + 1, 16, 17, 17, 17, 8, 8, 8, 64]


class SecretField:
    """Weights of the field: a table of three tag scores for each feature, and the transitions."""

    def __init__(self):
        self.tables = [np.zeros((size, 3)) for size in SIZES]
        self.moves = np.zeros((3, 3))

    def emissions(self, codes: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((*codes[0].shape, 3))
        for table, code in zip(self.tables, codes):
            out += table[code]
        return out

    def train(self, codes: list[np.ndarray], tags: np.ndarray, real: np.ndarray) -> None:
        """Maximum likelihood with a ridge, by Adam; codes, tags and real are (windows, tokens)."""
        params = [*self.tables, self.moves]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
        n, t = tags.shape
        pair = real[:, :-1] & real[:, 1:]
        for step in range(1, STEPS + 1):
            scores = self.emissions(codes)
            forward, backward = np.zeros((t, n, 3)), np.zeros((t, n, 3))
            forward[0] = scores[:, 0]
            for k in range(1, t):
                new = _logsum(forward[k - 1][:, :, None] + self.moves, 1) + scores[:, k]
                forward[k] = np.where(real[:, k, None], new, forward[k - 1])
            total = _logsum(forward[-1], 1)
            for k in range(t - 2, -1, -1):
                new = _logsum(self.moves + (scores[:, k + 1] + backward[k + 1])[:, None, :], 2)
                backward[k] = np.where(real[:, k + 1, None], new, 0)
            marginal = np.exp(forward.transpose(1, 0, 2) + backward.transpose(1, 0, 2) - total[:, None, None])
            error = (marginal - np.eye(3)[tags]) * real[:, :, None]
            grads = [np.stack([np.bincount(code.ravel(), error[:, :, y].ravel(), len(table)) for y in range(3)], axis=1) for table, code in zip(self.tables, codes)]
            moves = np.zeros((3, 3))
            for k in range(t - 1):
                joint = np.exp(forward[k][:, :, None] + self.moves + (scores[:, k + 1] + backward[k + 1])[:, None, :] - total[:, None, None])
                moves += (joint * pair[:, k, None, None]).sum(axis=0)
                np.subtract.at(moves, (tags[:, k][pair[:, k]], tags[:, k + 1][pair[:, k]]), 1)
            for p, g, (m, v) in zip(params, [*grads, moves], moments):
                g = (g + 0.02 * p) / n
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)

    def decode(self, tokens: Tokens) -> np.ndarray:
        """The best tags of all texts of the slice."""
        scores = self.emissions(tokens.codes)
        worst = 0.0  # the most that tagging a token B or I rather than O can gain through its transitions
        for tag in (B, I):
            inner = (self.moves[:, tag][:, None] + self.moves[tag][None, :]) - (self.moves[:, O][:, None] + self.moves[O][None, :])
            ends = np.concatenate((self.moves[:, tag] - self.moves[:, O], self.moves[tag] - self.moves[O]))
            worst = max(worst, float(inner.max()), float(ends.max()))
        open_at = np.flatnonzero(scores[:, O] - np.maximum(scores[:, B], scores[:, I]) <= worst)
        tags = np.zeros(len(scores), np.int8)
        if len(open_at) == 0:
            return tags
        new_run = np.flatnonzero((np.diff(open_at) > 1) | (np.diff(tokens.text[open_at]) > 0)) + 1
        for run in np.split(open_at, new_run):
            a, b = int(run[0]), int(run[-1])
            lead = a > 0 and tokens.text[a - 1] == tokens.text[a]
            trail = b + 1 < len(scores) and tokens.text[b + 1] == tokens.text[b]
            tags[a : b + 1] = viterbi(scores[a : b + 1], self.moves, O if lead else None, O if trail else None)
        return tags


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def viterbi(scores: np.ndarray, moves: np.ndarray, before: int | None = None, after: int | None = None) -> np.ndarray:
    """The best path through scores, next to fixed tags before and after it."""
    best = scores[0] + (moves[before] if before is not None else 0)
    back = []
    for row in scores[1:]:
        reach = best[:, None] + moves
        back.append(reach.argmax(axis=0))
        best = reach.max(axis=0) + row
    path = [int((best + (moves[:, after] if after is not None else 0)).argmax())]
    for pointer in reversed(back):
        path.append(int(pointer[path[-1]]))
    return np.array(path[::-1], np.int8)


def disguised(text: str, start: int, end: int, rng: np.random.Generator) -> tuple[str, list[tuple[int, int]]]:
    """The surroundings of a secret with another in its place, such as base patterns miss, and where that is."""
    upper, lower, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    alphabet = (lower + upper + digits, upper + digits, lower + digits, "0123456789ABCDEF", lower + upper + digits + "_-")[rng.integers(5)]
    value = "".join(rng.choice(list(alphabet), int(rng.integers(12, 45))))
    if rng.random() < 0.2:
        value = "".join(rng.choice(list(lower), int(rng.integers(2, 5)))) + str(rng.choice(["_", "-"])) + value
    if rng.random() < 0.3:
        value = f'"{value}"'
    lead = str(rng.choice(OTHER_WORDS)) + str(rng.choice(JOINTS)) if rng.random() < 0.7 else ""
    before, after = text[max(0, start - AROUND) : start], text[end : end + AROUND]
    if before and not before[-1].isspace():
        before += " "
    if after and not after[0].isspace():
        after = " " + after
    return before + lead + value + after, [(len(before) + len(lead), len(before) + len(lead) + len(value))]


def _labelled_windows(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Feature codes, tags and which tokens are real, of windows of the texts and of their disguised copies."""
    rng = np.random.default_rng(3)
    told = [(t, [(a, b) for a, _, b in base_spans(t)]) for t in texts]
    places = [(t, a, b) for t, spans in told for a, b in spans]
    copies = min(COPIES, -(-MOST_COPIES // max(1, len(places))))
    told += [disguised(t, a, b, rng) for t, a, b in places for _ in range(copies)][:MOST_COPIES]
    raw = [t.encode() for t, _ in told]
    offsets = np.cumsum([0, *map(len, raw)])
    data = np.frombuffer(b"".join(raw), np.uint8)
    tokens = Tokens(data, offsets)
    tags = np.zeros(len(tokens.starts), np.int8)
    if not len(tags):
        return [], np.zeros((0, WINDOW), np.int64), np.zeros((0, WINDOW), bool)
    for i, (text, spans) in enumerate(told):
        for start, end in spans:
            a, b = (int(offsets[i]) + len(text[:k].encode()) for k in (start, end))
            first, last = np.searchsorted(tokens.ends, a, side="right"), np.searchsorted(tokens.starts, b) - 1
            tags[first : last + 1] = np.where(tags[first : last + 1] == O, I, tags[first : last + 1])
            tags[first] = B
    hot = np.flatnonzero(tags == B)
    starts = np.concatenate((hot - rng.integers(3, WINDOW - 6, len(hot)), rng.integers(0, max(1, len(tags)), len(hot) + 1500)))
    starts = np.clip(rng.permutation(starts)[:MOST_WINDOWS], 0, max(0, len(tags) - WINDOW))
    at = starts[:, None] + np.arange(WINDOW)
    real = at < len(tags)
    at = np.minimum(at, max(0, len(tags) - 1))
    real &= tokens.text[at] == tokens.text[at[:, :1]]
    return [code[at] for code in tokens.codes], tags[at].astype(np.int64), real


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> SecretField:
    """Trains on a bounded sample of texts with and without base matches; base matches and their disguised copies are the labels."""
    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    hinted = F.col("text").rlike(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]|AKIA[A-Z0-9]{12}")
    sample = bounded_sample(rows.withColumn("hinted", hinted), "hinted", "id", TEXTS_PER_CLASS, 2).collect()
    found = [r["text"] for r in sorted(sample, key=lambda r: (not r["hinted"], str(r["id"]), r["text"]))]
    field = SecretField()
    codes, tags, real = _labelled_windows(found)
    if tags.size and real.any():
        field.train(codes, tags, real)
    else:
        field.tables[0][:, O] = 10.0
    return field


def _joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


def scan(docs: DataFrame, field: SecretField, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_added of every row. Added spans touch no base span."""
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        nothing = sha256(b"").hexdigest()
        for part, data, offsets in slices(batches, "text"):
            n = part.num_rows
            tokens = Tokens(data, offsets)
            tags = own.decode(tokens)
            counts, digest, spans, added = np.zeros((3, n), np.int64), [nothing] * n, [""] * n, np.zeros(n, np.int64)
            tagged = np.flatnonzero(tags != O)
            begins = tagged[(tags[tagged] == B) | (tags[tagged - 1] == O) | (tokens.text[tagged] != tokens.text[tagged - 1]) | (tagged == 0)]
            hot = np.unique(np.concatenate((np.flatnonzero(tokens.maybe_base), tokens.text[begins])))
            chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80))) if len(begins) else None  # code points before a byte
            owners = tokens.text[begins]
            for i in hot.tolist():
                raw = data[offsets[i] : offsets[i + 1]].tobytes()
                base = base_spans(raw.decode())
                for k, kind in enumerate(("assign", "access", "hex")):
                    counts[k, i] = sum(s[1] == kind for s in base)
                if base:
                    digest[i] = sha256(_joined(base).encode()).hexdigest()
                more = []
                for b in begins[np.searchsorted(owners, i) : np.searchsorted(owners, i, side="right")].tolist():
                    e = b
                    while e + 1 < len(tags) and tags[e + 1] == I and tokens.text[e + 1] == i:
                        e += 1
                    a, z = (int(chars[k] - chars[offsets[i]]) for k in (tokens.starts[b], tokens.ends[e]))
                    if not any(s < z and a < t for s, _, t in base):
                        more.append((a, "crf", z))
                added[i] = len(more)
                spans[i] = _joined(sorted(base + more, key=lambda s: (s[0], KINDS[s[1]])))
            columns = [part.column("doc_id"), *map(pa.array, counts), pa.array(digest, pa.string()), pa.array(spans, pa.string()), pa.array(added)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_added"])

    ddl = "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_added bigint"
    return rows.mapInArrow(released(scanned), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {ddl}")
