"""Secret scans: fixed patterns, and a linear-chain conditional random field that adds to them.

Tokens (runs of word characters, or of other visible ones) are tagged Begin,
Inside or Outside. Features of a token are its shape (length, kinds of
characters, changes between them), its neighbours (key words, separators and
quotes within three tokens) and its file (shares of digits and symbols, whether
an access key or a key word with a separator occurs). Emissions are sums of
weights of these binary features, looked up in two tables of 16 bits each.

The best tagging is found by Viterbi. A token whose Outside score leads by more
than any transitions around it could make up is Outside on every best path, so
it ends a chain; the tokens in between are decoded exactly.

The field is trained here, by gradient ascent on the likelihood of windows of
tokens. They come from a sample of about ``TRAIN_DOCS`` documents (all, if there
are fewer), drawn by the hash of doc_id and text, equal rows once. A document
gives windows around its pattern matches, two plain ones, and two into which
something is planted: a made-up secret behind a cue that the patterns don't read
(``bearer``, ``the key is``, other separators, or none), and a decoy (the same
cues before plain words, numbers, dates, paths, versions). So shape and
neighbours carry the decision where the patterns are blind. The lead that any
other tag needs over Outside is then set on windows held out from the training:
the least that leaves no plain or decoy token tagged, and ``MARGIN`` on top.

Spans are [start, end) in code points. Those of the patterns always stay (the
whole match is the span); the field's are added under the kind ``crf`` where
they touch none of these and are at least ``LEAST`` characters long.

A text of more than ``SLICE`` characters is tagged in slices, cut at white space,
whose file features are their own; the patterns read it whole.

Defined results: a null text is empty and has no spans; a table without a word
trains nothing and adds nothing; repeated rows are scanned each; a null doc_id
is a value like any other; other columns are ignored (``redacted`` keeps them).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from millrace.llm.textkit import batches, mix64, sent_in_parts, slices

# The kinds in the order in which they are listed, and their patterns.
KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(
    r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KEYWORDS = "password passwd secret token api apikey api_key key auth bearer credential credentials pwd access private".split()

TRAIN_DOCS, WINDOWS, REACH = 2000, 8, 12
LEAST = 8
#: Log odds added to the lead that the held-out windows ask for.
MARGIN = 2.0
#: Characters that are tagged at a time.
SLICE = 1 << 20
# What planted secrets and decoys are made of.
CUES = "{k} is {q}{v}{q}|{k} {q}{v}{q}|{k}: {q}{v}{q}|{k} = {q}{v}{q}|{k} -> {v}|the {k} {v}|{k}s were {v}|{w} {v} {w}".split("|")
LETTERS = "abcdefghijklmnopqrstuvwxyz"
SIGNS = {"mixed": LETTERS + LETTERS.upper() + "0123456789", "url": LETTERS + LETTERS.upper() + "0123456789_-", "base64": LETTERS + LETTERS.upper() + "0123456789+/", "hex": "0123456789abcdef", "upper": LETTERS.upper() + "0123456789"}
DECOYS = "{w}|{w}{w}|{w}-{n}|{n}|{n}.{n}|20{d}-0{d}-1{d}|+49 {n} {n}|v{d}.{d}.{d}-rc{d}|/{w}/{w}/{n}|{w}.{w}@{w}.example|{W}{W}|{w}_{w}_{d}|https://{w}.example/{w}?{w}={n}|{W}-{n}".split("|")
BEGIN, INSIDE, OUTSIDE = 0, 1, 2
NEVER = -1e6
#: Bits of a token's own features, then of its neighbourhood and file.
BITS = 32


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in order."""
    out: list[tuple[int, int, int]] = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _word_class() -> np.ndarray:
    c = np.full(128, 2, np.uint8)
    for x in range(128):
        if chr(x).isalnum() or chr(x) in "_+/-":
            c[x] = 1
        if x == 0x20 or 9 <= x <= 13:
            c[x] = 0
    return c


_CLASS = _word_class()
_SIDE = 3  # characters between two texts, so that neighbours within reach never cross
_KEYS = None


class Tokens:
    """Tokens of a batch of texts with the 32 feature bits of each."""

    def __init__(self, texts: list[str]):
        gap = " " * _SIDE
        points = np.frombuffer((gap + gap.join(texts) + gap).encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = np.where(points < 128, _CLASS[np.minimum(points, 127)], 1).astype(np.uint8)
        change = np.flatnonzero(np.diff(kind)) + 1
        edges = np.concatenate([[0], change, [len(kind)]])
        start, end = edges[:-1], edges[1:]
        keep = kind[start] > 0
        self.start, self.end = start[keep], end[keep]
        base = np.cumsum([_SIDE, *(len(t) + _SIDE for t in texts)])
        self.doc = np.searchsorted(base, self.start, side="right") - 1
        self.base = base
        self.n = len(texts)
        self.bits = self._features(points, kind) if len(self.start) else np.zeros(0, np.uint32)

    def _features(self, points: np.ndarray, kind: np.ndarray) -> np.ndarray:
        s, e, size = self.start, self.end, self.end - self.start
        digit = (points >= 48) & (points < 58)
        upper = (points >= 65) & (points < 91)
        lower = (points >= 97) & (points < 123)
        hexa = digit | ((points >= 97) & (points < 103))

        def count(mask: np.ndarray) -> np.ndarray:
            run = np.concatenate([[0], np.cumsum(mask, dtype=np.int32)])
            return run[e] - run[s]

        d, u, lo, hx = count(digit), count(upper), count(lower), count(hexa)
        turns = count(np.concatenate([[False], digit[1:] != digit[:-1]]))
        sort = digit + 2 * upper + 3 * np.isin(points, [ord(c) for c in "_+/-"])
        changes = count(np.concatenate([[False], sort[1:] != sort[:-1]])) - (sort[s] != sort[np.maximum(s - 1, 0)])
        word = kind[s] == 1
        sep, quote = count((points == 58) | (points == 61)) > 0, count((points == 34) | (points == 39)) > 0
        key = word & self._is_key(points)
        akia = (size >= 4) & (points[s] == 65) & (points[np.minimum(s + 1, len(points) - 1)] == 75) & (points[np.minimum(s + 2, len(points) - 1)] == 73)
        mixed = (u > 0) & (lo > 0) & (d > 0)
        own = [
            word, word & (size >= 8), word & (size >= 16), word & (size >= 24), word & (size >= 32), d > 0, (d > 0) & (u + lo > 0),
            word & (size >= 8) & (changes * 3 >= size), (d == size), (hx == size) & (d > 0) & (size >= 8), mixed & (size >= 8), (u + d == size) & (u > 0) & (size >= 8),
            word & (size >= 8) & (changes * 6 < size), turns >= 4, sep, key,
        ]

        def back(x: np.ndarray, n: int) -> np.ndarray:
            out = np.zeros_like(x)
            out[n:] = x[:-n] & (self.doc[n:] == self.doc[:-n])
            return out

        def ahead(x: np.ndarray, n: int) -> np.ndarray:
            out = np.zeros_like(x)
            out[:-n] = x[n:] & (self.doc[n:] == self.doc[:-n])
            return out

        signal = word & (size >= 8) & (turns >= 2)
        near = [
            quote, back(key, 1), back(key, 2), back(key, 3), back(sep, 1), back(sep, 2), back(quote, 1), ahead(quote, 1),
            back(key, 2) & back(sep, 1), back(key, 3) & back(sep, 2), back(signal, 1), signal & back(sep, 1), signal & back(quote, 1),
        ]
        per = lambda x: np.bincount(self.doc, weights=x, minlength=self.n)
        chars = np.maximum(per(size), 1)
        files = [per(d) / chars > 0.1, per(np.where(word, 0, size)) / chars > 0.15, per(akia | (key & ahead(sep, 1))) > 0]
        bits = np.zeros(len(s), np.uint32)
        for i, f in enumerate([*own, *near, *(f[self.doc] for f in files)]):
            bits |= f.astype(np.uint32) << np.uint32(i)
        return bits

    def _is_key(self, points: np.ndarray) -> np.ndarray:
        """Tokens that are key words, by a sum over their lower-case characters."""
        global _KEYS
        low = np.where((points >= 65) & (points < 91), points + 32, points).astype(np.uint64)
        size = self.end - self.start
        most = max(map(len, KEYWORDS))
        out = np.zeros(len(size), bool)
        at = np.flatnonzero(size <= most)
        if _KEYS is None:
            _KEYS = np.array(sorted(int(_spell(np.array([[ord(c) for c in k.ljust(most, "\0")]], np.uint64))[0]) for k in KEYWORDS), np.uint64)
        grid = np.zeros((len(at), most), np.uint64)
        for i in range(most):
            has = size[at] > i
            grid[has, i] = low[self.start[at[has]] + i]
        out[at] = np.isin(_spell(grid), _KEYS)
        return out


def _spell(grid: np.ndarray) -> np.ndarray:
    h = np.zeros(len(grid), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(grid.shape[1]):
            h = mix64(h + grid[:, i] + np.uint64(0x9E3779B97F4A7C15))
    return h


class Field:
    """Weights of the conditional random field: emissions [BITS + 1, 3] (the last row is the bias), transitions [3, 3]."""

    def __init__(self, emit: np.ndarray, move: np.ndarray):
        self.emit, self.move = emit, move.copy()
        self.move[OUTSIDE, INSIDE] = NEVER
        half = np.arange(1 << 16)
        on = ((half[:, None] >> np.arange(16)) & 1).astype(np.float32)
        self.low = (on @ emit[:16] + emit[BITS]).astype(np.float32)
        self.high = (on @ emit[16:32]).astype(np.float32)

    def emissions(self, bits: np.ndarray) -> np.ndarray:
        return self.low[bits & 0xFFFF] + self.high[bits >> 16]

    def ahead(self, lead: float) -> "Field":
        """This field with so much added to the score of Outside."""
        emit = self.emit.copy()
        emit[BITS, OUTSIDE] += lead
        return Field(emit, self.move)

    def decode(self, bits: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Best tags; ``first`` marks the first token of each text."""
        n = len(bits)
        tags = np.full(n, OUTSIDE, np.int8)
        if not n:
            return tags
        e = self.emissions(bits)
        t = self.move
        lead = e[:, OUTSIDE] - np.maximum(e[:, BEGIN], e[:, INSIDE])
        swap = max(0.0, float((e[:, INSIDE] - e[:, BEGIN]).max()))
        ways = [t[p, s] + t[s, q] - t[p, OUTSIDE] - t[OUTSIDE, q] for p in range(3) for s in (0, 1) for q in (BEGIN, OUTSIDE)]
        ways += [t[p, s] + t[s, INSIDE] + t[INSIDE, q] - t[p, OUTSIDE] - t[OUTSIDE, BEGIN] - t[BEGIN, q] + swap for p in range(3) for s in (0, 1) for q in range(3)]
        ways += [t[s, q] - t[OUTSIDE, q] for s in (0, 1) for q in (BEGIN, OUTSIDE)] + [t[p, s] - t[p, OUTSIDE] for p in range(3) for s in (0, 1)]
        open_ = lead <= max(ways)
        begins = np.flatnonzero(open_ & (first | ~np.concatenate([[False], open_[:-1]])))
        if not len(begins):
            return tags
        stops = np.flatnonzero(open_ & np.concatenate([~open_[1:] | first[1:], [True]])) + 1
        # a chain runs with the Outside tokens next to it in its text, whose tags are certain
        before = (begins > 0) & ~first[begins]
        after = (stops < n) & ~np.concatenate([first, [True]])[stops]
        size = stops - begins
        for i in range(0, len(begins), 4096):
            self._chains(e, tags, begins[i : i + 4096], size[i : i + 4096], before[i : i + 4096], after[i : i + 4096])
        return tags

    def _chains(self, e: np.ndarray, tags: np.ndarray, begin: np.ndarray, size: np.ndarray, before: np.ndarray, after: np.ndarray) -> None:
        order = np.argsort(-size, kind="stable")
        begin, size, before, after = begin[order], size[order], before[order], after[order]
        score = e[begin].astype(np.float64)
        score += np.where(before[:, None], self.move[OUTSIDE][None, :], np.array([0, NEVER, 0])[None, :])
        came = []
        for step in range(1, int(size[0])):
            live = int(np.searchsorted(-size, -step, side="left"))
            way = score[:live, :, None] + self.move[None]
            best = way.argmax(axis=1)
            came.append(best.astype(np.int8))
            score[:live] = np.take_along_axis(way, best[:, None, :], axis=1)[:, 0] + e[begin[:live] + step]
        score += np.where(after[:, None], self.move[:, OUTSIDE][None, :], 0)
        now = score.argmax(axis=1)
        for step in range(int(size[0]) - 1, -1, -1):
            live = int(np.searchsorted(-size, -step, side="left"))
            tags[begin[:live] + step] = now[:live]
            if step:
                now[:live] = came[step - 1][np.arange(live), now[:live]]


def fit(bits: np.ndarray, tags: np.ndarray, length: np.ndarray, rounds: int = 80, decay: float = 1e-3) -> Field:
    """Train on padded windows (rows of feature bits and tags, with their lengths) by Adam on the mean log likelihood."""
    n, most = bits.shape
    x = np.concatenate([((bits[:, :, None] >> np.arange(BITS)) & 1), np.ones((n, most, 1), np.uint32)], axis=2).astype(np.float32)
    real = np.arange(most)[None, :] < length[:, None]
    gold = np.zeros((n, most, 3), np.float32)
    np.put_along_axis(gold, tags[:, :, None].astype(np.int64), 1, axis=2)
    gold *= real[:, :, None]
    pairs = real[:, 1:, None, None] * gold[:, :-1, :, None] * gold[:, 1:, None, :]
    flat = x.reshape(-1, BITS + 1)
    want_e, want_t = flat.T @ gold.reshape(-1, 3), pairs.sum((0, 1))
    emit, move = np.zeros((BITS + 1, 3)), np.zeros((3, 3))
    state = [np.zeros_like(emit), np.zeros_like(emit), np.zeros_like(move), np.zeros_like(move)]
    total = max(1, int(real.sum()))
    seen = real[:, :, None]
    for r in range(1, rounds + 1):
        e = (flat @ emit.astype(np.float32)).reshape(n, most, 3)
        see, step = np.exp(e - e.max(axis=2, keepdims=True)).astype(np.float64), np.exp(move)
        # forwards and backwards in probabilities, scaled at each token; a window's end is carried through its padding
        a, scale = np.empty((n, most, 3)), np.ones((n, most, 1))
        scale[:, 0] = see[:, 0].sum(axis=1, keepdims=True)
        a[:, 0] = see[:, 0] / scale[:, 0]
        for t in range(1, most):
            x = (a[:, t - 1] @ step) * see[:, t]
            scale[:, t] = np.where(seen[:, t], x.sum(axis=1, keepdims=True), 1)
            a[:, t] = np.where(seen[:, t], x / scale[:, t], a[:, t - 1])
        b = np.ones((n, most, 3))
        got_t = np.zeros((3, 3))
        for t in range(most - 2, -1, -1):
            ahead = np.where(seen[:, t + 1], see[:, t + 1] * b[:, t + 1] / scale[:, t + 1], 0)
            got_t += a[:, t].T @ ahead
            b[:, t] = np.where(seen[:, t + 1], ahead @ step.T, 1)
        got_t *= step
        p = a * b * seen
        got_e = flat.T @ p.reshape(-1, 3).astype(np.float32)
        for k, (w, g) in enumerate(((emit, (want_e - got_e) / total - decay * emit / 10), (move, (want_t - got_t) / total - decay * move / 10))):
            m1, m2 = state[2 * k], state[2 * k + 1]
            m1 += 0.1 * (g - m1)
            m2 += 0.01 * (g * g - m2)
            w += 0.15 * (m1 / (1 - 0.9**r)) / (np.sqrt(m2 / (1 - 0.99**r)) + 1e-8)
    return Field(emit, move)


def _valued(text: str) -> list[tuple[int, int]]:
    """What the fixed patterns find (of an assignment, its value)."""
    spans = [(m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    return sorted(spans + [m.span() for p in (ACCESS, HEX) for m in p.finditer(text)])


def _tagged(tokens: Tokens, spans: list[list[tuple[int, int]]]) -> np.ndarray:
    """Tags of the tokens of each text from its spans."""
    tags = np.full(len(tokens.start), OUTSIDE, np.int8)
    for d, of in enumerate(spans):
        for s, e in of:
            i = np.searchsorted(tokens.end, s + tokens.base[d], side="right")
            j = np.searchsorted(tokens.start, e + tokens.base[d], side="left")
            if i < j and tags[i] == OUTSIDE:
                tags[i] = BEGIN
                tags[i + 1 : j] = INSIDE
    return tags


def planted(text: str, rng: np.random.Generator, secret: bool) -> tuple[str, int, int]:
    """``text`` with a made-up secret or a decoy at a gap between words, and the place of its value."""
    pick = lambda of: of[int(rng.integers(len(of)))]
    gaps = [m.start() for m in re.finditer(r"\s", text[: 1 << 16])]
    at = pick(gaps) if gaps else len(text)
    words = [w for w in text[max(0, at - 400) : at + 400].split() if w.isalpha()] or ["text"]
    number = lambda: str(int(rng.integers(10 ** int(rng.integers(1, 8)))))
    cue = pick(CUES)
    if secret:
        kind = pick(list(SIGNS))
        size = int(rng.integers(16, 32) if kind in ("hex", "upper") else rng.integers(24 if "{k}" not in cue else 12, 41))
        value = "".join(pick(SIGNS[kind]) for _ in range(size))
    else:
        value = re.sub(r"\{(.)\}", lambda m: {"w": lambda: pick(words), "W": lambda: pick(words).upper(), "n": number, "d": lambda: str(int(rng.integers(10)))}[m[1]](), pick(DECOYS))
    key = pick(KEYWORDS)
    cue = cue.replace("{k}", pick([key, key.capitalize(), key.upper()])).replace("{q}", pick(["", "", '"', "'"])).replace("{w}", pick(words))
    lead = " " + cue[: cue.index("{v}")]
    start = at + len(lead)
    return text[:at] + lead + value + cue[cue.index("{v}") + 3 :] + text[at:], start, start + len(value)


def _windows(text: str, seed: int) -> list[tuple[int, list[int], list[int]]]:
    """(1 if nothing in it is a secret, bits, tags) of a document's training windows."""
    rng = np.random.default_rng(seed & (2**63 - 1))
    texts, spans, centres = [text], [_valued(text)], [None]
    for secret in (True, False):
        t, s, e = planted(text, rng, secret)
        found = _valued(t)
        if secret and not any(x < e and s < y for x, y in found):
            found = sorted([*found, (s, e)])
        texts.append(t)
        spans.append(found)
        centres.append(s)
    out = []
    for t, of, centre in zip(texts, spans, centres, strict=True):
        tokens = Tokens([t])
        n = len(tokens.start)
        if not n:
            continue
        tags = _tagged(tokens, [of])
        if centre is None:
            at = np.flatnonzero(tags == BEGIN).tolist()[: WINDOWS - 2] + [n // 3, 2 * n // 3]
        else:
            at = [int(np.searchsorted(tokens.end, centre + tokens.base[0], side="right"))]
        for c in at:
            i, j = max(0, c - REACH), min(n, c + REACH + 1)
            while i > 0 and tags[i] == INSIDE:
                i -= 1
            x, y = tokens.bits[i:j][: 2 * REACH + 1], tags[i:j][: 2 * REACH + 1]
            out.append((int((y == OUTSIDE).all()), x.astype(np.int64).tolist(), y.tolist()))
    return out


def learnt(windows: list[tuple[int, list[int], list[int]]]) -> Field | None:
    """A field from the windows, four fifths of them, with its lead over Outside set on the rest."""
    windows = [w for w in windows if w[1]]
    if not any(not clean for clean, _, _ in windows):
        return None
    length = np.array([len(x) for _, x, _ in windows])
    most = int(length.max())
    bits, tags = np.zeros((len(windows), most), np.uint32), np.full((len(windows), most), OUTSIDE, np.int8)
    for i, (_, x, y) in enumerate(windows):
        bits[i, : len(x)], tags[i, : len(y)] = x, y
    rest = np.arange(len(windows)) % 5 == 4
    field = fit(bits[~rest], tags[~rest], length[~rest])
    held = [windows[i] for i in np.flatnonzero(rest)]
    flat = np.array([b for _, x, _ in held for b in x], np.uint32)
    gold = np.array([t for _, _, y in held for t in y], np.int8)
    first = np.zeros(len(flat), bool)
    first[np.cumsum([0, *(len(x) for _, x, _ in held)])[:-1]] = True
    lead = 0.0
    while len(flat) and lead < 12 and ((field.ahead(lead).decode(flat, first) != OUTSIDE) & (gold == OUTSIDE)).any():
        lead += 0.5
    return field.ahead(lead + MARGIN)


def train(docs: DataFrame) -> Field | None:
    """A field from a sample of the documents, or None where they hold no word."""
    n = docs.count()
    share = 1.0 if n <= TRAIN_DOCS else TRAIN_DOCS / n
    drawn = docs.where("text IS NOT NULL").select(F.xxhash64("doc_id", "text", F.lit(3)).alias("h"), "text")
    sample = drawn.where(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30)))

    def go(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.list_(pa.int64())), pa.list_(pa.list_(pa.int32()))]
        for b in rows:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                found = [_windows(t, h) for h, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
                cols = [part.column(0).to_pylist(), *([[w[k] for w in ws] for ws in found] for k in range(3))]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["h", "clean", "bits", "tags"])

    schema = "h long, clean array<int>, bits array<array<long>>, tags array<array<int>>"
    each = sent_in_parts(sample).mapInArrow(go, schema).groupBy("h").agg(*[F.first(c).alias(c) for c in ("clean", "bits", "tags")])
    got = each.orderBy("h").limit(2 * TRAIN_DOCS).collect()  # a bounded number of short windows
    return learnt([w for r in got for w in zip(r.clean, r.bits, r.tags, strict=True)])


def find(texts: list[str], field: Field | None) -> list[list[tuple[int, int, int]]]:
    """(start, kind, end) of all spans of each text, by start and then kind."""
    out = [base_spans(t) for t in texts]
    if field is None:
        return out
    parts = [(d, at, part) for d, t in enumerate(texts) for at, part in slices(t, SLICE)]
    for _, some in batches(parts, 256, size=lambda p: len(p[2])):
        _add(out, some, field)
    return out


def _add(out: list[list[tuple[int, int, int]]], parts: list[tuple[int, int, str]], field: Field) -> None:
    """Add the field's spans in (text, offset, slice) to those found."""
    tokens = Tokens([p for _, _, p in parts])
    n = len(tokens.start)
    if not n:
        return
    first = np.concatenate([[True], tokens.doc[1:] != tokens.doc[:-1]])
    tags = field.decode(tokens.bits, first)
    begin = np.flatnonzero((tags == BEGIN) | (tags == INSIDE) & np.concatenate([[True], tags[:-1] == OUTSIDE]) | (tags == INSIDE) & first)
    more = np.concatenate([(tags[1:] == INSIDE) & ~first[1:], [False]])
    for i in begin.tolist():
        j = i
        while more[j]:
            j += 1
        d, at, _ = parts[int(tokens.doc[i])]
        shift = at - int(tokens.base[tokens.doc[i]])
        s, e = int(tokens.start[i]) + shift, int(tokens.end[j]) + shift
        if e - s >= LEAST and not any(s < b_end and b_start < e for b_start, _, b_end in out[d]):
            out[d] = sorted([*out[d], (s, 3, e)])


def scan(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, spans: array<struct<kind, start, end>> of every row; trains on ``docs`` unless a field is given."""
    field = field or train(docs)
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def go(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for b in rows:
            found: list[list[dict]] = []
            for _, texts in batches((t or "" for t in b.column(1).to_pylist()), 256):
                found += [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans] for spans in find(texts, shared.value)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], ["doc_id", "spans"])

    return sent_in_parts(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(go, "doc_id long, spans array<struct<kind:string,start:int,end:int>>")


def redacted(docs: DataFrame, mark: str = "[SECRET]", field: Field | None = None) -> DataFrame:
    """``docs`` with every span replaced by ``mark`` and, where there is one, n_chars counted again."""
    field = field or train(docs)
    shared = docs.sparkSession.sparkContext.broadcast(field)
    at = docs.columns.index("text")

    def clean(text: str, spans: list[tuple[int, int, int]]) -> str:
        out, here = [], 0
        for s, _, e in spans:
            if s > here or (s == here and e > here):
                out += [text[here:s], mark]
            here = max(here, e)
        return "".join([*out, text[here:]])

    def go(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            new: list[str | None] = []
            held = b.column(at).to_pylist()
            for first, texts in batches((t or "" for t in held), 256):
                found = find(texts, shared.value)
                new += [None if held[first + i] is None else clean(t, f) if f else t for i, (t, f) in enumerate(zip(texts, found, strict=True))]
            yield b.set_column(at, b.schema.field(at), pa.array(new, b.schema.field(at).type))

    done = sent_in_parts(docs).mapInArrow(go, StructType(docs.schema.fields))
    if StructField("n_chars", LongType()) in docs.schema.fields:
        done = done.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))
    return done
