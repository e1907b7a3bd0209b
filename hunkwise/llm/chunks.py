"""Operator 8, substring dedup by content-defined chunks.

A gear hash rolls over a text's bytes; a chunk ends where its top bits are zero,
with ``least`` and ``most`` bytes as bounds. The hash depends on the last 32 bytes
alone, so chunks line up again soon after an insertion. Chunks with equal digests
are copies: the first one (least document id, then place) stays, the others
are removed. Runs of copies shorter than ``run_bytes`` stay as well: a phrase
is no passage.

Counts are aggregated before they are shuffled and joined back from written tables;
a digest with very many copies is a skewed join and no group is gathered. Texts are
joined by id and hash.

Null and empty texts have no chunks and stay. Rows equal in id and text (null ids
too) count as one document and get the same result. Empty tables give no rows.
Extra columns are ignored by ``dedup`` and kept by ``deduplicated``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hunkwise.llm._shared import Scratch, lean, row_key, text_bytes

#: Average bytes of a chunk are about ``LEAST + 2**BITS``.
LEAST, MOST, BITS = 24, 256, 5
#: Bytes of consecutive copies from which they are removed. A passage loses its edges to chunks
#: that begin before or end after it; this is short enough for what is left of 50 words.
RUN_BYTES = 64
#: Bytes handled together; bounds the memory of a long text.
SEGMENT = 1 << 20


def _gear(seed: int = 8) -> np.ndarray:
    """A table of 256 values for the rolling hash, made by a multiplicative generator."""
    out, x = [], seed * 0x9E3779B97F4A7C15 + 1
    for _ in range(256):
        x = (x * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        out.append(x >> 32)
    return np.array(out, np.uint32)


_GEAR = _gear()


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """Rolling hash at each byte: the sum of the last 32 bytes' values, shifted by their age."""
    h = _GEAR[data]
    for step in (1, 2, 4, 8, 16):
        later = h.copy()
        later[step:] += h[:-step] << np.uint32(step)
        h = later
    return h


def cut_places(text: bytes, least: int = LEAST, most: int = MOST, bits: int = BITS) -> list[int]:
    """The ends of a text's chunks."""
    n = len(text)
    if not n:
        return []
    found = []
    for lo in range(0, n, SEGMENT):
        start = max(0, lo - 31)
        h = gear_hashes(np.frombuffer(text, np.uint8, min(n, lo + SEGMENT) - start, start))
        found.append(np.flatnonzero(h >> np.uint32(32 - bits) == 0) + start + 1)
        if lo:
            found[-1] = found[-1][found[-1] > lo]
    ends, at = [], 0
    for c in np.concatenate(found).tolist():
        while c - at > most:
            at += most
            ends.append(at)
        if c - at >= least:
            at = c
            ends.append(at)
    while n - at > most:
        at += most
        ends.append(at)
    if at < n:
        ends.append(n)
    return ends


def _chunk_task(least: int, most: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = TaskContext.get().partitionId() << 40
        for batch in batches:
            rids, ends, high, low = [], [], [], []
            for text in batch.column(2):
                text = text.as_py()
                places = cut_places(text, least, most, bits)
                sums = b"".join(hashlib.blake2b(text[a:b], digest_size=16).digest() for a, b in zip([0, *places], places, strict=False))
                words = np.frombuffer(sums, np.int64).reshape(-1, 2)
                rids.append(n)
                n += 1
                ends.append(places)
                high.append(words[:, 0])
                low.append(words[:, 1])
            arrays = [batch.column(0), batch.column(1), pa.array(rids, pa.int64()), pa.array(ends, pa.list_(pa.int32())), pa.array(high, pa.list_(pa.int64())), pa.array(low, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["_id", "_th", "rid", "stop", "d1", "d2"])

    return run


def _remove_task(run_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for text, copies in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                text = text.as_py()
                spans: list[list[int]] = []
                for c in sorted(copies or [], key=lambda c: c["start"]):
                    if spans and spans[-1][1] == c["start"]:
                        spans[-1][1] = c["stop"]
                    else:
                        spans.append([c["start"], c["stop"]])
                # A chunk may end inside a character: what is removed begins and ends at characters.
                whole = lambda i: next((i + k for k in range(4) if i + k >= len(text) or text[i + k] & 0xC0 != 0x80), i)
                spans = [[whole(a), whole(b)] for a, b in spans if b - a >= run_bytes]
                kept, at = [], 0
                for a, b in [*spans, [len(text), len(text)]]:
                    kept.append(text[at:a])
                    at = b
                for c, x in zip(out, (len(text), sum(b - a for a, b in spans), len(spans), b"".join(kept)), strict=True):
                    c.append(x)
            names = ["n_bytes", "n_removed", "n_spans", "kept"]
            arrays = [pa.array(c, k) for c, k in zip(out, [pa.int64(), pa.int64(), pa.int64(), pa.binary()], strict=True)]
            yield pa.RecordBatch.from_arrays([*arrays, *batch.columns[2:]], names=[*names, *batch.schema.names[2:]])

    return run


def copies(docs: DataFrame, scratch: Scratch, least: int, most: int, bits: int, id_col: str, text_col: str) -> DataFrame:
    """``_id, _th, copies``: the chunks of each document that another chunk comes before."""
    keyed = docs.select(*row_key(id_col, text_col), text_bytes(text_col).alias("_t"))
    schema = "_id long, _th long, rid long, stop array<int>, d1 array<long>, d2 array<long>"
    texts = scratch.put(keyed.mapInArrow(lean(_chunk_task(least, most, bits)), schema), "texts")
    # One row id, the least, stands for rows equal in id and text.
    one = texts.select("_id", "_th", F.posexplode(F.arrays_zip("stop", "d1", "d2")).alias("at", "c"), "stop")
    one = one.select("_id", "_th", F.col("c.d1").alias("d1"), F.col("c.d2").alias("d2"), F.when(F.col("at") > 0, F.element_at("stop", F.greatest("at", F.lit(1)))).otherwise(0).alias("start"), F.col("c.stop").alias("stop"))
    place = F.struct("_id", "_th", "start")
    first = one.groupBy("d1", "d2").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    first = scratch.put(first.where("first <> last").select("d1", "d2", "first"), "first")
    scratch.release()
    later = one.join(first, ["d1", "d2"]).where(place != F.col("first")).select("_id", "_th", "start", "stop")
    later = scratch.put(later, "later")
    scratch.release()
    return later.groupBy("_id", "_th").agg(F.collect_set(F.struct("start", "stop")).alias("copies"))


def _cut(docs: DataFrame, keep: list[str], least: int, most: int, bits: int, run_bytes: int, id_col: str, text_col: str) -> DataFrame:
    scratch = Scratch(docs.sparkSession, "chunks")
    found = scratch.put(copies(docs, scratch, least, most, bits, id_col, text_col), "copies")
    for name in ("texts", "first", "later"):
        scratch.drop(name)
    scratch.release()
    keyed = docs.select(*row_key(id_col, text_col), text_bytes(text_col).alias("_t"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(keep)])
    joined = keyed.join(found.hint("shuffle_hash"), ["_id", "_th"], "left").select("_t", "copies", *[f"_c{i}" for i in range(len(keep))])
    kinds = ", ".join(f"_c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    return joined.mapInArrow(lean(_remove_task(run_bytes)), f"n_bytes long, n_removed long, n_spans long, kept binary, {kinds}")


def dedup(docs: DataFrame, least: int = LEAST, most: int = MOST, bits: int = BITS, run_bytes: int = RUN_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, text``: what is left of each text."""
    out = _cut(docs, [id_col], least, most, bits, run_bytes, id_col, text_col)
    return out.select(F.col("_c0").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.col("kept").cast("string").alias("text"))


def deduplicated(docs: DataFrame, least: int = LEAST, most: int = MOST, bits: int = BITS, run_bytes: int = RUN_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with all their columns and what is left of each text (a null text stays null)."""
    keep = list(docs.columns)
    out = _cut(docs, keep, least, most, bits, run_bytes, id_col, text_col)
    text = F.when(F.col(f"_c{keep.index(text_col)}").isNotNull(), F.col("kept").cast("string"))
    return out.select(*[(text if c == text_col else F.col(f"_c{i}")).alias(c) for i, c in enumerate(keep)])
