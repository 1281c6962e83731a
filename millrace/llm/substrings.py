"""Removal of repeated word windows by fixed-block anchors.

A window is ``WINDOW`` consecutive words of one document; it is a repeat if its
word sequence also starts earlier (smaller doc_id, or earlier in the document).
Every word that a repeat covers is removed.

Any window of 20 words holds a whole block of the 10-word blocks that its
document is cut into. So the blocks, which don't overlap, are the index, and
every rolling run of 10 words of every document probes it: both occurrences of
a repeat hold a run that is a block of the other (or the same aligned block
twice). A hit is extended to all windows around it; these are compared exactly,
by 96 bits of hash of their 20 words, and neighbouring repeats join to maximal
repeated spans.

The index is probed through a filter of bounded size (``bitfilter``), so the
rolling runs themselves, ten times the index, are never shuffled; a false
positive only puts windows up for comparison. In a document's own windows the
first of equal ones is found on the spot, so one row a (sequence, document) is
shuffled, a hot sequence is combined map-side (the smallest doc_id and a count),
and its rows meet that by a join that Spark can split. Documents with equal
texts are settled beforehand: only the smallest doc_id is compared, the others
are repeats from end to end. Texts are only moved for documents that lose words.

Defined results: a null text has no words; fewer than 20 words are never a
window; rows that repeat a doc_id are one document (the same result each, and
never each other's repeat); rows with a null doc_id keep all their words and
aren't compared; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import bitfilter
from millrace.llm.textkit import Words, batches, combine, mix64, seeded, sent_in_parts
from millrace.session import materialise

WINDOW, BLOCK = 20, 10
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPAN = "array<struct<start:int,end:int>>"
_C = seeded(11, 1)


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def sha(words: list[str]) -> str:
    return hashlib.sha256(" ".join(words).encode("utf-8", "surrogatepass")).hexdigest()


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, same (equal for equal texts), n_words, whole_sha256 and the hashes of the blocks."""

    def go(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            at = 0
            for _, texts in batches((t or "" for t in b.column(1).to_pylist()), 256):
                w = Words(texts)
                first, h = w.windows(BLOCK)
                doc = w.doc[first] if len(first) else first
                whole = (first - w.first[doc]) % BLOCK == 0
                offsets = np.concatenate([[0], np.cumsum(np.bincount(doc[whole], minlength=len(texts)))])
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(at, len(texts)),
                        pa.array([hashlib.md5(t.encode("utf-8", "surrogatepass")).digest() for t in texts], pa.binary()),
                        pa.array(np.diff(w.first), pa.int64()),
                        pa.array([sha(words_of(t)) for t in texts], pa.string()),
                        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(h[whole].view(np.int64), pa.int64())),
                    ],
                    ["doc_id", "same", "n_words", "whole_sha256", "blocks"],
                )
                at += len(texts)

    schema = "doc_id long, same binary, n_words long, whole_sha256 string, blocks array<long>"
    return sent_in_parts(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(go, schema)


def hits(w: Words, index: np.ndarray, twice: np.ndarray) -> np.ndarray:
    """First words of the rolling runs that may be a block elsewhere."""
    at, h = w.windows(BLOCK)
    if not len(at):
        return at
    own = (at - w.first[w.doc[at]]) % BLOCK == 0
    ok = np.zeros(len(at), bool)
    ok[own] = bitfilter.passes(twice, h[own])
    ok[~own] = bitfilter.passes(index, h[~own])
    return at[ok]


def extended(w: Words, found: np.ndarray) -> np.ndarray:
    """First words of all windows that hold one of the runs."""
    n = len(w.hash)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.maximum(found - (WINDOW - BLOCK), w.first[w.doc[found]]), 1)
    np.add.at(edge, found + 1, -1)
    at = np.flatnonzero(np.cumsum(edge[:n]) > 0)
    at = at[at + WINDOW <= n]
    return at[w.doc[at] == w.doc[at + WINDOW - 1]]


def windows_up(docs: DataFrame, reps: np.ndarray, index: np.ndarray, twice: np.ndarray) -> DataFrame:
    """a, b (hash), doc_id, pos, again: windows put up for comparison; ``again`` where the document has it earlier itself."""
    shared = docs.sparkSession.sparkContext.broadcast((reps, index, twice))  # each of bounded size

    def go(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reps, index, twice = shared.value
        for b in rows:
            b = b.filter(pa.array(bitfilter.passes(reps, b.column(2).to_numpy())))
            ids, at = b.column(0).to_numpy(), 0
            for _, texts in batches((t or "" for t in b.column(1).to_pylist()), 256):
                w = Words(texts)
                here = ids[at : at + len(texts)]
                at += len(texts)
                found = hits(w, index, twice)
                if not len(found):
                    continue
                s = extended(w, found)
                parts = [w.hash[s + k] for k in range(WINDOW)]
                with np.errstate(over="ignore"):
                    x, y = mix64(combine(parts, 2)), mix64(combine(parts, 3)) >> np.uint64(32)
                    mine = mix64(x ^ (w.doc[s].astype(np.uint64) * _C[0]))
                _, first = np.unique(mine, return_index=True)
                again = np.ones(len(s), bool)
                again[first] = False
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(x.view(np.int64), pa.int64()), pa.array(y.astype(np.uint32).view(np.int32), pa.int32()),
                        pa.array(here[w.doc[s]], pa.int64()), pa.array((s - w.first[w.doc[s]]).astype(np.int32), pa.int32()), pa.array(again),
                    ],
                    ["a", "b", "doc_id", "pos", "again"],
                )

    rows = sent_in_parts(docs).where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text").withColumn("h", F.xxhash64("doc_id"))
    return rows.mapInArrow(go, "a long, b int, doc_id long, pos int, again boolean")


def spans_of(starts: np.ndarray) -> list[dict[str, int]]:
    """Maximal spans that the windows cover; starts ascend."""
    if not len(starts):
        return []
    new = np.flatnonzero(np.concatenate([[True], starts[1:] > starts[:-1] + WINDOW]))
    ends = np.concatenate([starts[new[1:] - 1], starts[-1:]]) + WINDOW
    return [{"start": int(s), "end": int(e)} for s, e in zip(starts[new], ends, strict=True)]


def _joined(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in rows:
        spans = [spans_of(np.unique(np.asarray(p, np.int64))) for p in b.column(1).to_pylist()]
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, kind)], ["doc_id", "spans"])


class Repeats:
    """Repeated spans of the documents; ``scanned`` and ``spans`` are written tables."""

    def __init__(self, docs: DataFrame):
        self.docs = docs
        self.scanned = materialise(scan(docs), "anchors-blocks")
        self.first = self.scanned.where("doc_id IS NOT NULL").groupBy("same").agg(F.min("doc_id").alias("doc_id"))
        reps = self.first.select("doc_id")
        own = self.scanned.where("n_words >= 20").select("doc_id", "blocks").join(reps, "doc_id", "left_semi")
        blocks = own.select(F.explode("blocks").alias("h"))
        counted = materialise(blocks.groupBy("h").count(), "anchors-index")
        twice = counted.where("count > 1").select("h")
        ids = reps.select(F.xxhash64("doc_id").alias("h"))
        up = materialise(
            windows_up(
                docs,
                bitfilter.build(ids, bitfilter.size_for(ids.count())),
                bitfilter.build(counted.select("h"), bitfilter.size_for(counted.count())),
                bitfilter.build(twice, bitfilter.size_for(twice.count())),
            ),
            "anchors-windows",
        )
        fresh = up.where("NOT again")
        known = fresh.groupBy("a", "b").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
        later = fresh.join(known, ["a", "b"]).where("doc_id > least").select("doc_id", "pos")
        starts = later.union(up.where("again").select("doc_id", "pos")).groupBy("doc_id").agg(F.collect_list("pos").alias("starts"))
        self.spans = materialise(starts.mapInArrow(_joined, f"doc_id long, spans {SPAN}"), "anchors-spans")

    def with_spans(self) -> DataFrame:
        """doc_id, n_words, whole_sha256, spans (removed word ranges) of every row of the documents."""
        # by (doc_id, same), not by the text alone, which may be that of a third of the rows
        first = self.first.withColumn("is_first", F.lit(True))
        all_of_it = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end"))).cast(SPAN)
        again = F.col("is_first").isNull() & F.col("doc_id").isNotNull() & (F.col("n_words") >= WINDOW)
        return (
            self.scanned.drop("blocks").join(first, ["doc_id", "same"], "left").join(self.spans, "doc_id", "left")
            .select("doc_id", "n_words", "whole_sha256", F.when(again, all_of_it).otherwise(F.coalesce("spans", F.array().cast(SPAN))).alias("spans"))
        )


def kept_words(text: str | None, spans: list[dict[str, int]]) -> list[str]:
    words, out, at = words_of(text), [], 0
    for s in spans:
        out += words[at : s["start"]]
        at = s["end"]
    return out + words[at:]


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that are left, joined by one space), spans of every row."""
    found = Repeats(docs).with_spans().select("doc_id", "n_words", "spans").distinct()

    def go(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            kept = [" ".join(kept_words(t, s or [])) for t, s in zip(b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(kept, pa.string())], ["doc_id", "n_words", "spans", "kept"])

    whole = docs.select(F.col("doc_id").cast("long"), "text").join(found.where("doc_id IS NOT NULL"), "doc_id", "left")
    done = whole.select("doc_id", "text", "n_words", "spans").mapInArrow(go, f"doc_id long, n_words long, spans {SPAN}, kept string")
    return done.withColumn("n_removed", F.aggregate(F.coalesce("spans", F.array().cast(SPAN)), F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row; texts meet their spans only where some words stay and some go."""
    r = Repeats(docs)
    ids = r.spans.select(F.xxhash64("doc_id").alias("h"))
    some = docs.sparkSession.sparkContext.broadcast(bitfilter.build(ids, bitfilter.size_for(ids.count())))

    def pick(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            yield b.filter(pa.array(bitfilter.passes(some.value, b.column(2).to_numpy())))

    def go(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            kept = [sha(kept_words(t, s)) for t, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.string())], ["doc_id", "left_sha256"])

    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text").withColumn("h", F.xxhash64("doc_id"))
    left = texts.mapInArrow(pick, "doc_id long, text string, h long").drop("h").join(r.spans, "doc_id").mapInArrow(go, "doc_id long, left_sha256 string")
    rows = r.with_spans().withColumn("n_removed", F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]))
    none = hashlib.sha256(b"").hexdigest()
    return rows.join(left.distinct(), "doc_id", "left").select(
        "doc_id", "n_words", "n_removed",
        F.when(F.col("n_removed") == 0, F.col("whole_sha256")).when(F.col("n_removed") == F.col("n_words"), none).otherwise(F.col("left_sha256")).alias("kept_sha256"),
    )
