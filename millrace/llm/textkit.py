"""Arrays over the characters of a batch of texts, shared by the operators that read whole texts in numpy."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
from pyspark.sql import DataFrame

#: Characters of one numpy batch; a longer text is a batch of its own.
BATCH_CHARS = 1 << 19
#: Rows that a Python worker is sent at once.
ARROW_ROWS = 1000
#: Bytes that are hashed at a time.
STRETCH = 1 << 20


def sent_in_parts(docs: DataFrame) -> DataFrame:
    """``docs``, with the session's Arrow batches held to ``ARROW_ROWS``, as whole texts are large rows."""
    conf, key = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= ARROW_ROWS:
        conf.set(key, str(ARROW_ROWS))
    return docs


def batches(texts: Iterable[Any], most_rows: int = 1024, most_chars: int = BATCH_CHARS, size: Callable[[Any], int] = len) -> Iterator[tuple[int, list[Any]]]:
    """(first row, texts) of consecutive batches, bounded in rows and characters."""
    first, held, chars = 0, [], 0
    for t in texts:
        if held and (len(held) >= most_rows or chars + size(t) > most_chars):
            yield first, held
            first, held, chars = first + len(held), [], 0
        held.append(t)
        chars += size(t)
    if held:
        yield first, held


def slices(text: str, most: int) -> Iterator[tuple[int, str]]:
    """(offset, slice) of a text in parts of at most ``most`` characters, each but the last cut behind white space where it has any."""
    at = 0
    while len(text) - at > most:
        end = at + most
        cut_at = max(text.rfind(c, at + 1, end) for c in " \n\t") + 1
        end = cut_at if cut_at > at else end
        yield at, text[at:end]
        at = end
    yield at, text[at:] if at else text


def mix64(x: np.ndarray) -> np.ndarray:
    """Bits of uint64 values well mixed (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeded(seed: int, n: int) -> np.ndarray:
    """n odd uint64 constants."""
    with np.errstate(over="ignore"):
        return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


class Words:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of a batch of texts, in order.

    Besides the text itself, its bytes and a mask of them, memory goes with the
    number of words: a text of 100 MB needs about 700 MB.

    A word's hash is that of its UTF-8 bytes: a polynomial in an odd base modulo
    2**64 over random values of the bytes, taken from running sums, then mixed.
    ``doc[i]`` is the text of word i, ``first[d]`` the index of text d's first
    word (one more entry at the end).
    """

    SPACE = np.zeros(256, bool)
    SPACE[[0x20, *range(0x09, 0x0E)]] = True

    def __init__(self, texts: list[str], seed: int = 0):
        raw = " ".join(texts).encode("utf-8", "surrogatepass") + b" "
        b = np.frombuffer(raw, np.uint8)
        space = self.SPACE[b]
        edge = np.flatnonzero(np.diff(space.view(np.int8), prepend=1))
        starts, ends = edge[::2], edge[1::2]
        self.hash = np.empty(len(starts), np.uint64)
        at = 0
        while at < len(starts):  # some words at a time: arrays as long as the text are only held in bytes
            to = max(at + 1, int(np.searchsorted(ends, starts[at] + STRETCH)))
            self.hash[at:to] = _word_hashes(raw, b, starts[at:to], ends[at:to], seed)
            at = to
        sizes = np.fromiter((len(t.encode("utf-8", "surrogatepass")) + 1 for t in texts), np.int64, len(texts))
        edges = np.concatenate([[0], np.cumsum(sizes)])
        self.first = np.searchsorted(starts, edges)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def windows(self, n: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of every run of n words within one text."""
        m = len(self.hash) - n + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.doc[:m] == self.doc[n - 1 :])
        return at, mix64(combine([self.hash[k : k + m] for k in range(n)], seed)[at])


def combine(parts: list[np.ndarray], seed: int) -> np.ndarray:
    c = seeded(seed, len(parts))
    out = np.zeros(len(parts[0]), np.uint64)
    with np.errstate(over="ignore"):
        for k, p in enumerate(parts):
            out += p * c[k]
    return out


def _word_hashes(raw: bytes, b: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """Hashes of neighbouring words; one that is longer than a stretch is hashed by itself."""
    lo, hi = int(starts[0]), int(ends[-1])
    if hi - lo > STRETCH:
        word = hashlib.blake2b(raw[lo:hi], digest_size=8, salt=seed.to_bytes(8, "little")).digest()
        return np.frombuffer(word, np.uint64)
    base, inverse, values = _tables(seed, STRETCH)
    with np.errstate(over="ignore"):
        run = np.concatenate([[np.uint64(0)], np.cumsum(values[b[lo:hi]] * base[: hi - lo], dtype=np.uint64)])
        h = (run[ends - lo] - run[starts - lo]) * inverse[starts - lo]
        return mix64(h + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


_kept: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def _tables(seed: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse up to n, and the bytes' values."""
    got = _kept.get(seed)
    if got is None or len(got[0]) < n:
        size = max(n, 1 << 16)
        base = int(seeded(seed + 17, 1)[0])
        with np.errstate(over="ignore"):
            up = np.full(size, base, np.uint64)
            up[0] = 1
            down = np.full(size, pow(base, -1, 1 << 64), np.uint64)
            down[0] = 1
            got = (np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64), seeded(seed + 91, 256))
        _kept[seed] = got
    return got
