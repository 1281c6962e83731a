"""SentencePiece encoding and decoding (merge-type models) by a prefix table.

In a merge-type model a sequence of pieces is the encoding of its text exactly
if every two neighbouring pieces are: each pair, encoded on its own, comes back
as that pair. So each prefix of a text has one last piece. ``Codec`` finds it
for every prefix in turn: an automaton gives the pieces that end there, and the
one that is compatible with the last piece of the prefix before it is stored;
the ids are then recovered from the end backwards. Compatibility of a pair is
decided once, by merging its few characters, and remembered.

Texts are cut into segments first, where no piece of the model can reach across
(before a run of word marks, and around characters that occur in no longer
piece, such as a line feed). The encodings of short segments are kept in a
bounded cache in each worker. New ones are taken a batch of texts at a time, in
sorted order: words begin alike, and the part of the table that belongs to the
prefix shared with the word before stays as it is. Only long segments are run
through the automaton. A new segment is decoded from its ids and held against its
text; while all come back as they were, a text's decoding is known from theirs,
and otherwise it is made from the ids.

Covered models: BPE with the identity normaliser, escaped white space, byte
fallback and no user-defined pieces; others are refused. The model's bytes are
broadcast (a fixed file, whose path is a parameter).

Defined results: a null text is encoded as the empty text (no ids, decoded to
the empty text); repeated rows are kept; other columns pass through or are
ignored, as the function says.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.llm.textkit import batches, sent_in_parts

MARK = "▁"
MODEL = "piece_bpe_32k.model"
#: Segments and pairs kept by a worker, the longest segment that is kept, and characters of a batch of texts.
CACHE_SEGMENTS, CACHE_PAIRS, CACHE_CHARS, BATCH_CHARS = 400_000, 500_000, 48, 1 << 21
#: Stands before the first piece of a segment (below the complement of any code point).
NONE = -0x200000


def _varint(b: bytes, i: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        x = b[i]
        i += 1
        out |= (x & 127) << shift
        shift += 7
        if x < 128:
            return out, i


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol buffer message."""
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        if key & 7 == 0:
            v, i = _varint(b, i)
        else:
            n, i = (8, i) if key & 7 == 1 else (4, i) if key & 7 == 5 else _varint(b, i)
            v, i = b[i : i + n], i + n
        yield key >> 3, v


class Kept:
    """A bounded dictionary: what hasn't been asked for since half of it was filled anew is dropped."""

    def __init__(self, most: int):
        self.half, self.young, self.old = most // 2, {}, {}

    def get(self, key):
        if (got := self.young.get(key)) is None and (got := self.old.get(key)) is not None:
            self.put(key, got)
        return got

    def put(self, key, value) -> None:
        if len(self.young) >= self.half:
            self.old, self.young = self.young, {}
        self.young[key] = value


class Codec:
    def __init__(self, model: bytes):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.pieces = [sp.id_to_piece(i) for i in range(sp.vocab_size())]
        self.bytes = {i: int(self.pieces[i][3:5], 16) for i in range(len(self.pieces)) if sp.is_byte(i)}
        self.byte_id = {b: i for i, b in self.bytes.items()}
        plain = [i for i in range(len(self.pieces)) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        self.scores = {self.pieces[i]: sp.get_score(i) for i in plain}
        self._refuse_others(model, [sp.is_unused(i) for i in plain])
        self.joined = {c for p in self.ids if len(p) > 1 for c in p}
        self.length = [len(p) for p in self.pieces]
        self.decimal = [str(i) for i in range(len(self.pieces))]
        self.spaced = [p.replace(MARK, " ") for p in self.pieces]
        #: Ends of pieces: the piece, or -1 where it is the end of longer ones only.
        self.ends = {p[i:]: -1 for p in self.ids for i in range(1, len(p))} | self.ids
        self.numbers = list(range(len(self.pieces)))  # one object each
        #: By key: what follows the mark of a segment, or a line feed and a segment without one.
        self.pairs, self.kept = Kept(CACHE_PAIRS), Kept(CACHE_SEGMENTS)
        self.faithful = True  # every segment so far was decoded to its own text
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.split_lines = "\n" not in self.joined
        self.marks = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")

    def _refuse_others(self, model: bytes, unused: list[bool]) -> None:
        top = dict(_fields(model))
        trainer, normalizer = dict(_fields(top.get(2, b""))), dict(_fields(top.get(3, b"")))
        user = any(dict(_fields(v)).get(3, 1) == 4 for f, v in _fields(model) if f == 1)
        inner = any(MARK in p.lstrip(MARK) for p in self.ids)
        if (
            trainer.get(3) != 2 or not trainer.get(35) or trainer.get(24) or user or any(unused) or inner
            or normalizer.get(2) or normalizer.get(3, 1) != 1 or normalizer.get(4, 1) != 0 or normalizer.get(5, 1) != 1
            or len(self.byte_id) != 256
        ):
            raise ValueError("only BPE models with the identity normaliser and byte fallback are covered")

    def merge(self, text: str) -> list[str]:
        """Best merge first, leftmost among equals; for the few characters of a pair."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fit(self, before: int, piece: int) -> bool:
        """Whether ``piece`` may follow ``before``; NONE before it: stand at the start."""
        key = before << 24 | piece
        ok = self.pairs.get(key)
        if ok is None:
            a = "" if before == NONE else self.pieces[before] if before >= 0 else chr(~before)
            b = self.pieces[piece]
            ok = self.merge(a + b) == ([a, b] if a else [b])
            self.pairs.put(key, ok)
        return ok

    def extend(self, last: list[int], text: str) -> None:
        """Carry the table on from the prefix it holds to the end of a short text."""
        ends, pairs, numbers = self.ends, self.pairs, self.numbers
        for n in range(len(last) + 1, len(text) + 1):
            start, found = n - 1, []
            while start >= 0 and (piece := ends.get(text[start:n])) is not None:
                if piece >= 0:
                    found.append((piece, last[start - 1] if start else NONE))
                start -= 1
            for piece, before in reversed(found):  # the longest first
                ok = pairs.young.get(before << 24 | piece)
                if ok or ok is None and self.fit(before, piece):
                    last.append(numbers[piece])
                    break
            else:
                last.append(~ord(text[n - 1]))

    def table(self, text: str) -> list[int]:
        """The last piece of each prefix, from the one of length 1; the complement of its code point for a character without a piece."""
        last: list[int] = []
        n = 0
        for end, (piece, length) in self.automaton.iter(text):  # in order of their ends
            if end < n:
                continue
            while n < end:
                last.append(~ord(text[n]))
                n += 1
            before = last[end - length] if length <= end else NONE
            if self.fit(before, piece):
                last.append(piece)
                n += 1
        last += [~ord(c) for c in text[n:]]
        return last

    def back(self, text: str, last: list[int]) -> list[int]:
        """Ids of a segment, recovered backwards from its prefix table."""
        end, out = len(text), []
        while end:
            piece = last[end - 1]
            if piece < 0:
                out += [self.byte_id[x] for x in reversed(chr(~piece).encode())]
                end -= 1
            else:
                out.append(piece)
                end -= self.length[piece]
        out.reverse()
        return out

    def added(self, keys: list[str]) -> dict[str, str]:
        """Ids in decimal by key, of segments that aren't kept."""
        out, held, last = {}, "", []
        for key in sorted(keys):
            text = key[1:] if self.split_lines and key[:1] == "\n" else MARK + key
            if short := len(text) <= CACHE_CHARS:
                n = 0
                for x, y in zip(held, text):  # noqa: B905
                    if x != y:
                        break
                    n += 1
                del last[n:]
                self.extend(last, text)
                held, table = text, last
            else:
                table = self.table(text)
            ids = self.back(text, table)
            if self.faithful and self.text_of(ids) != text.replace(MARK, " "):
                self.faithful = False
            out[key] = got = ",".join([self.decimal[i] for i in ids])
            if short:
                self.kept.put(key, got)
        return out

    def text_of(self, ids: list[int] | tuple[int, ...]) -> str:
        """Decoded text of ids, with word marks as spaces and the first of them kept."""
        if self.bytes.keys().isdisjoint(ids):
            return "".join([self.spaced[i] for i in ids])
        out: list[str] = []
        held = bytearray()
        for i in ids:
            if i in self.bytes:
                held.append(self.bytes[i])
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            out.append(self.spaced[i])
        if held:
            out.append(held.decode("utf-8", "replace"))
        return "".join(out)

    def keys(self, text: str) -> list[str]:
        """The segments of a text, as keys."""
        out: list[str] = []
        for n, line in enumerate(text.split("\n") if self.split_lines else [text]):
            if n:
                out.append("\n\n")
                if not line:
                    continue
            words = line.split(" ")
            if "" in words or MARK in line:  # runs of marks; only the first line has a mark of its own in front
                whole = (MARK if not n else "") + line.replace(" ", MARK)
                out += [s[1:] if s[0] == MARK else "\n" + s for s in self.marks.findall(whole)]
                continue
            if n:
                words[0] = "\n" + words[0]
            out += words
        return out

    def batch(self, texts: list[str]) -> list[list[str]]:
        """Ids in decimal, segment by segment, of each text."""
        keyed = [self.keys(t) if t else [] for t in texts]
        out = [list(map(self.kept.young.get, keys)) for keys in keyed]
        asked = {k for keys, got in zip(keyed, out, strict=True) if None in got for k, g in zip(keys, got, strict=True) if g is None}
        known = {k: g for k in asked if (g := self.kept.get(k)) is not None}
        known |= self.added([k for k in asked if k not in known])
        return [[g or known[k] for k, g in zip(keys, got, strict=True)] if None in got else got for keys, got in zip(keyed, out, strict=True)]

    def encode(self, text: str) -> list[int]:
        return _ids(self.batch([text])[0])

    def decoded(self, text: str, segments: list[str]) -> str:
        """What the ids of a text are decoded to."""
        return text.replace(MARK, " ") if self.faithful else self.decode(_ids(segments))

    def decode(self, ids: list[int]) -> str:
        text = self.text_of(ids)
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=2)
def codec(model: bytes) -> Codec:
    return Codec(model)


def model_bytes(path: str | None = None) -> bytes:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(MODEL)
    with open(path, "rb") as f:
        return f.read()


def _mapped(docs: DataFrame, new: dict[str, tuple[str, pa.DataType]], row, path: str | None, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns to keep and what ``row(codec, text, its segments)`` makes of it."""
    model = docs.sparkSession.sparkContext.broadcast(model_bytes(path))
    docs = docs.select(F.col("doc_id").cast("long"), *keep, "text")
    held = StructType(docs.schema.fields[:-1])

    def run(sent: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model.value)
        for b in sent:
            texts = [t or "" for t in b.column(b.num_columns - 1).to_pylist()]
            for at, held_texts in batches(texts, most_chars=BATCH_CHARS):
                part = b.slice(at, len(held_texts))
                rows = [row(c, t, segments) for t, segments in zip(held_texts, c.batch(held_texts), strict=True)]
                cols = list(zip(*rows, strict=True)) or [[] for _ in new]
                arrays = [*part.columns[:-1], *(pa.array(v, t) for v, (_, t) in zip(cols, new.values(), strict=True))]
                yield pa.RecordBatch.from_arrays(arrays, [*held.names, *new])

    kinds = [f"{name} {kind}" for name, (kind, _) in new.items()]
    schema = StructType([*held.fields, *StructType.fromDDL(", ".join(kinds)).fields])
    return sent_in_parts(docs).mapInArrow(run, schema)


def _ids(segments: list[str]) -> list[int]:
    return list(map(int, ",".join(segments).split(","))) if segments else []


def _real(c: Codec, text: str, segments: list[str]) -> tuple:
    return _ids(segments), c.decoded(text, segments)


def _digest(c: Codec, text: str, segments: list[str]) -> tuple:
    ids = ",".join(segments)
    n = ids.count(",") + 1 if ids else 0
    return n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(c.decoded(text, segments).encode()).hexdigest()


def encode_documents(docs: DataFrame, path: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns to keep, ids, decoded of each row."""
    new = {"ids": ("array<int>", pa.list_(pa.int32())), "decoded": ("string", pa.string())}
    return _mapped(docs, new, _real, path, keep)


def digest_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row: ``encode_documents`` with its outputs hashed where they are made."""
    text = ("string", pa.string())
    return _mapped(docs, {"n_tokens": ("long", pa.int64()), "ids_sha256": text, "decoded_sha256": text}, _digest, path)
