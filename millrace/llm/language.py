"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1 (drawn from its code point). A run
of three symbols is the product of its letters' vectors, each permuted by its
place (rotated by 2, 1, 0); a text is the sum of its runs' vectors, a language
the sum of its training texts. A text gets the language whose prototype has the
largest cosine with it. Symbols are lower-case letters, anything else bounds a
word; runs have a letter in the middle, so they don't reach across words.

Prototypes are sums, so each partition adds up its own and the parts are added
by an aggregation; languages times ``DIM`` numbers reach the driver and are
broadcast, a packed row each, with ``MAX_LANGUAGES`` checked first. Prediction is a map.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
so is every text where nothing could be learned. The score is the cosine, held
to 0 .. 1; ties go to the language that sorts first. Rows with a null doc_id are
predicted, not learned from, and aren't held out. Repeated rows count each. A
text of any length is taken in slices cut behind white space, whose sums add up
to the whole's. Columns that are already named as what is added (a parameter) are
replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from millrace.llm.textkit import batches, sent_in_parts, slices

DIM = 512
SEED = 20_240_601
MAX_LANGUAGES = 2000
UNKNOWN = "und"
#: Rows and characters of one product of counts and run vectors.
ROWS, CHARS = 128, 1 << 20


class Symbols:
    """Compact numbers for the letters met so far, with their vectors; 0 is the boundary."""

    def __init__(self):
        self.of = np.full(0x110000, -1, np.int32)
        self.code = [0]
        self.vectors = np.zeros((64, DIM), np.int8)
        self.vectors[0] = self._vector(0)

    @staticmethod
    def _vector(code: int) -> np.ndarray:
        return (np.random.default_rng([SEED, code]).integers(0, 2, DIM) * 2 - 1).astype(np.int8)

    def __call__(self, points: np.ndarray) -> np.ndarray:
        got = self.of[points]
        if (got < 0).any():
            for p in np.unique(points[got < 0]).tolist():
                self.of[p] = self._number(p)
            got = self.of[points]
        return got

    def _number(self, point: int) -> int:
        c = chr(point)
        if not c.isalpha():
            return 0
        low = c.lower()
        if len(low) == 1 and ord(low) != point:
            if self.of[ord(low)] < 0:
                self.of[ord(low)] = self._number(ord(low))
            return int(self.of[ord(low)])
        n = len(self.code)
        if n == len(self.vectors):
            self.vectors = np.concatenate([self.vectors, np.zeros_like(self.vectors)])
        self.vectors[n] = self._vector(point)
        self.code.append(point)
        return n


_symbols: Symbols | None = None


def symbols() -> Symbols:
    global _symbols
    if _symbols is None:
        _symbols = Symbols()
    return _symbols


def runs(texts: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """(text, run) of every run in the batch, runs as numbers to the base that is returned."""
    s = symbols()
    joined = " " + " ".join(texts) + " "
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    sym = s(points).astype(np.int64)
    base = len(s.code)
    at = np.flatnonzero(sym[1:-1]) + 1
    run = (sym[at - 1] * base + sym[at]) * base + sym[at + 1]
    edges = np.cumsum([1, *(len(t) + 1 for t in texts)])
    return np.searchsorted(edges, at, side="right") - 1, run, base


def distinct(run: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct runs, and the place of each run among them."""
    if base**3 <= 1 << 22:
        seen = np.zeros(base**3, np.int32)
        seen[run] = 1
        kinds = np.flatnonzero(seen)
        seen[kinds] = np.arange(len(kinds), dtype=np.int32)
        return kinds, seen[run]
    return np.unique(run, return_inverse=True)


def run_vectors(kinds: np.ndarray, base: int) -> np.ndarray:
    v = symbols().vectors
    a, b, c = kinds // base // base, kinds // base % base, kinds % base
    return np.roll(v, 2, axis=1)[a] * np.roll(v, 1, axis=1)[b] * v[c]


def _profiles(pairs: Iterator[tuple[str, str]]) -> dict[str, np.ndarray]:
    """Sums of the run vectors of each language's texts."""
    out: dict[str, np.ndarray] = {}
    held = list(pairs)
    for lang in sorted({x for x, _ in held}):
        total = np.zeros(DIM)
        parts = (part for x, t in held if x == lang for _, part in slices(t, CHARS))
        for _, texts in batches(parts, most_rows=1 << 30):
            _, run, base = runs(texts)
            kinds, place = distinct(run, base)
            n = np.bincount(place, minlength=len(kinds)).astype(np.float64)
            for i in range(0, len(kinds), 4096):
                total += n[i : i + 4096] @ run_vectors(kinds[i : i + 4096], base).astype(np.float64)
        out[lang] = total
    return out


def _fold() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 5


def held_out() -> Column:
    return F.coalesce(_fold() == 0, F.lit(False))


def learned_from() -> Column:
    """The rest, but for rows without a doc_id, whose remainder is unknown."""
    return F.coalesce(_fold() != 0, F.lit(False))


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their prototypes, from text and lang of all rows of ``docs`` that have both."""

    def part(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in rows:
            for at in range(0, b.num_rows, 2048):
                some = b.slice(at, 2048)
                for lang, v in _profiles(zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True)).items():
                    total[lang] = total.get(lang, 0) + v
        for lang, v in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang]), pa.array([v.astype(np.int64).tolist()], pa.list_(pa.int64()))], ["lang", "v"]
            )

    known = docs.where("lang IS NOT NULL AND text IS NOT NULL")
    sums = (
        sent_in_parts(known).select("lang", "text").mapInArrow(part, "lang string, v array<long>")
        .select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
        .groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("v"))
    )
    got = sums.limit(MAX_LANGUAGES + 1).collect()
    if len(got) > MAX_LANGUAGES:
        raise ValueError(f"lang has more than {MAX_LANGUAGES} values")
    found = {r.lang: np.array(r.v, np.float64) for r in got if any(r.v)}
    langs = sorted(found)
    return langs, np.stack([found[x] for x in langs]) if langs else np.zeros((0, DIM))


def predict(texts: list[str], langs: list[str], prototypes: np.ndarray) -> tuple[list[str], list[float], list[int]]:
    """Language, cosine and number of letters of each text."""
    names, scores, letters = [UNKNOWN] * len(texts), [0.0] * len(texts), np.zeros(len(texts), np.int64)
    unit = (prototypes / np.linalg.norm(prototypes, axis=1, keepdims=True)).astype(np.float32)
    vectors = np.zeros((len(texts), DIM), np.float32)
    parts = ((d, part) for d, t in enumerate(texts) for _, part in slices(t, CHARS))
    for _, some in batches(parts, ROWS, CHARS, size=lambda p: len(p[1])):
        of = np.array([d for d, _ in some])
        part, run, base = runs([t for _, t in some])
        if not len(run):
            continue
        np.add.at(letters, of, np.bincount(part, minlength=len(some)))
        kinds, place = distinct(run, base)
        for i in range(0, len(kinds), 8192):
            here = (place >= i) & (place < i + 8192) if len(kinds) > 8192 else slice(None)
            width = min(8192, len(kinds) - i)
            n = np.bincount(part[here] * width + place[here] - i, minlength=len(some) * width).reshape(len(some), width)
            more = n.astype(np.float32) @ run_vectors(kinds[i : i + width], base).astype(np.float32)
            if of[-1] - of[0] == len(of) - 1:  # a slice a text
                vectors[of[0] : of[-1] + 1] += more
            else:
                np.add.at(vectors, of, more)
    if langs:
        cos = (vectors @ unit.T) / np.maximum(np.linalg.norm(vectors, axis=1), 1e-9)[:, None]
        best = cos.argmax(axis=1)
        for d in np.flatnonzero(letters).tolist():
            names[d], scores[d] = langs[best[d]], float(min(1.0, max(0.0, cos[d, best[d]])))
    return names, scores, letters.tolist()


#: Columns that ``identify`` adds.
ADDED = ("lang_pred", "score", "letters")


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray] | None = None, added: tuple[str, str, str] = ADDED) -> DataFrame:
    """``docs`` with the predicted language, its score and the number of letters; learns from the rows that aren't held out unless a model is given."""
    langs, prototypes = model or train(docs.where(learned_from()))
    docs = docs.drop(*added)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((langs, prototypes))  # at most MAX_LANGUAGES * DIM numbers
    at = docs.columns.index("text")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for i in range(0, b.num_rows, 1024):
                some = b.slice(i, 1024)
                names, scores, letters = predict([t or "" for t in some.column(at).to_pylist()], *shared.value)
                new = [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(letters, pa.int64())]
                yield pa.RecordBatch.from_arrays([*some.columns, *new], [*some.schema.names, *added])

    kinds = (StringType(), DoubleType(), LongType())
    schema = StructType([*docs.schema.fields, *(StructField(c, k) for c, k in zip(added, kinds, strict=True))])
    return sent_in_parts(docs).mapInArrow(run, schema)
