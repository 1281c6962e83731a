"""A filter of bounded size over 64-bit hashes: no false negatives, few false positives.

Its size is a parameter with a bound, so it can be broadcast whatever the data.
Where it fills up, more rows pass it; what comes after it decides exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm.textkit import mix64

#: Largest size: 2 ** 30 bits are 128 MB.
MOST_BITS = 30
LEAST_BITS = 20
PROBES = 4
#: Bits that one task fills at a time.
BLOCK = 18
#: Hashes that a task packs together.
GATHER = 1 << 19


def size_for(n: int) -> int:
    """Bits (as a power of two) that keep false positives near 0.1 % for n hashes, within the bound."""
    return min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(1, n) * 16))))


def places(h: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    h = h.view(np.uint64)
    for k in range(PROBES):
        yield (mix64(h + np.uint64(k)) >> np.uint64(64 - bits)).astype(np.int64)


def build(hashes: DataFrame, bits: int) -> np.ndarray:
    """The filter of the single long column of ``hashes``, filled by blocks in parallel; 2 ** bits bits reach the driver."""

    def packed(held: list[np.ndarray]) -> pa.RecordBatch:
        with np.errstate(over="ignore"):
            at = np.unique(np.concatenate(list(places(np.concatenate(held), bits))))
        of = at >> BLOCK
        blocks, first = np.unique(of, return_index=True)
        inside = (at & ((1 << BLOCK) - 1)).astype(np.uint32)
        parts = [x.tobytes() for x in np.split(inside, first[1:])] if len(blocks) else []
        return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(parts, pa.binary())], ["block", "inside"])

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # one row a block for up to GATHER hashes of a task, not for each of its batches
        held: list[np.ndarray] = []
        for b in batches:
            held.append(b.column(0).to_numpy())
            if sum(map(len, held)) >= GATHER:
                yield packed(held)
                held = []
        if held:
            yield packed(held)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come sorted by block, so that one block is held at a time
        seen, at = np.zeros(1 << BLOCK, bool), None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([np.packbits(seen).tobytes()], pa.binary())], ["block", "bits"])

        for b in batches:
            for i in range(b.num_rows):
                block = b.column(0)[i].as_py()
                if block != at:
                    if at is not None:
                        yield done()
                        seen[:] = False
                    at = block
                seen[np.frombuffer(b.column(1)[i].as_buffer(), np.uint32)] = True
        if at is not None:
            yield done()

    out = np.zeros(1 << (bits - 3), np.uint8)
    width = 1 << (BLOCK - 3)
    parts = hashes.mapInArrow(scatter, "block long, inside binary").repartition("block").sortWithinPartitions("block").mapInArrow(fill, "block long, bits binary")
    for r in parts.collect():
        out[r.block * width : (r.block + 1) * width] = np.frombuffer(r.bits, np.uint8)
    return out


def passes(filled: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether each hash may be one of those the filter was built from."""
    bits = int(math.log2(len(filled))) + 3
    left = np.arange(len(h))
    with np.errstate(over="ignore"):
        for k in range(PROBES):
            at = (mix64(h[left].view(np.uint64) + np.uint64(k)) >> np.uint64(64 - bits)).astype(np.int64)
            left = left[(filled[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0]
    out = np.zeros(len(h), bool)
    out[left] = True
    return out
